"""Learned confidence: weighted logistic regression and a forest of stumps next to the rule score."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.session import checkpoint

# Weights of rules, regression and forest, and the least number of examples.
GRAPH_WEIGHTS = (0.6, 0.2, 0.2)
TEXT_WEIGHTS = (0.3, 0.35, 0.35)
MIN_EXAMPLES_GRAPH = 50
MIN_EXAMPLES_TEXT = 10


def training_examples(*frames: DataFrame) -> DataFrame:
    """One table ``features, label, weight, source`` from labelled feature tables.

    Each input has ``features`` and ``is_correct``; ``confidence`` (1.0) and ``source`` ("manual")
    are optional.
    """
    def shape(df: DataFrame) -> DataFrame:
        weight = F.coalesce("confidence", F.lit(1.0)) if "confidence" in df.columns else F.lit(1.0)
        source = F.coalesce("source", F.lit("manual")) if "source" in df.columns else F.lit("manual")
        return df.select("features", F.col("is_correct").cast("double").alias("label"), weight.alias("weight"), source.alias("source"))

    return reduce(DataFrame.unionByName, map(shape, frames))


def train_confidence(examples: DataFrame, min_examples: int = MIN_EXAMPLES_GRAPH, seed: int = 42) -> PipelineModel:
    """Fit both models; raises ValueError with fewer than ``min_examples`` rows.

    Both fits read the examples several times, so they are written once to the shared checkpoint folder.
    """
    examples = checkpoint(examples.select("features", "label", "weight"), "examples")
    n = examples.count()
    if n < min_examples:
        raise ValueError(f"Need at least {min_examples} examples, have {n}")
    lr = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=200, standardization=True,
                            predictionCol="lr_prediction", probabilityCol="lr_probability", rawPredictionCol="lr_raw").fit(examples)
    forest = RandomForestClassifier(numTrees=10, maxDepth=1, featureSubsetStrategy="5", maxBins=4, seed=seed,
                                    predictionCol="rf_prediction", probabilityCol="rf_probability", rawPredictionCol="rf_raw").fit(examples)
    return PipelineModel(stages=[lr, forest])


def score_confidence(df: DataFrame, rule_score: Column, model: PipelineModel | None = None,
                     weights: tuple[float, float, float] = GRAPH_WEIGHTS) -> DataFrame:
    """Append the component scores and their weighted ``confidence``; rules alone without a model."""
    df = df.withColumn("rule_score", rule_score)
    if model is None:
        return df.withColumns({"lr_score": F.col("rule_score"), "rf_score": F.col("rule_score"), "confidence": F.col("rule_score")})
    scored = model.transform(df).withColumns({
        "lr_score": vector_to_array("lr_probability")[1], "rf_score": vector_to_array("rf_probability")[1]})
    parts = F.col("rule_score") * weights[0] + F.col("lr_score") * weights[1] + F.col("rf_score") * weights[2]
    return scored.withColumn("confidence", parts).drop(
        "lr_prediction", "lr_probability", "lr_raw", "rf_prediction", "rf_probability", "rf_raw")


def accuracy(scored: DataFrame, score: str = "confidence", label: str = "label") -> DataFrame:
    """Share of rows whose score above one half agrees with the label."""
    right = (F.col(score) > 0.5) == (F.col(label) > 0.5)
    return scored.agg(F.count(F.lit(1)).alias("num_examples"), F.avg(right.cast("double")).alias("training_accuracy"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
