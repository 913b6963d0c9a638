"""COVERAGE.md names functions and queries that exist; lexicons and models can be replaced."""

import importlib
import pathlib
import re

import pytest
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimspark.operators import ml as ML
from claimspark.operators.kb import resolved_labels
from claimspark.operators.propaganda import literal_anchors, with_propaganda
from claimspark.sources import seeds

ROWS = re.findall(r"^\| ([A-Z]\d+) \| (\S+) \| (\S+) \|$", pathlib.Path(__file__).parents[1].joinpath("COVERAGE.md").read_text(encoding="utf-8"), re.M)


def test_every_row_exists():
    assert len(ROWS) == 171 and len({r[0] for r in ROWS}) == 171
    for ident, path, name in ROWS:
        module, function = path.rsplit(".", 1)
        assert hasattr(importlib.import_module(f"claimspark.{module}"), function), ident
        assert name == "-" or name in entry.queries(), ident


def test_lexicons_are_replaceable(spark):
    df = spark.createDataFrame([("Buy now, grey or gray, xx yes",)], "text string")
    patterns = (("push", 1.0, "", [r"\b(buy|order) now\b"]), ("shade", 1.0, "", [r"\b(gr[ae]y)\b", r"\b(No|never)\b"]), ("opt", 1.1, "", [r"\b(x+ yes|a{2})\b", r"YES"]))
    row = with_propaganda(df, patterns=patterns, narratives={"sale": ["buy", "now"], "none": ["a1", "a2"]}).first()
    assert {t["technique"]: t["confidence"] for t in row["techniques"]} == {"push": 0.6, "shade": 0.7, "opt": 0.66}
    assert row["narratives"] == ["sale"]


@pytest.mark.parametrize("regex, want", [
    (r"\b(threat|danger)\w*\b", ["threat", "danger"]), (r"\b(the (real|true) history)\b", [" history"]), (r"\b(gr[ae]y)\b", ["gr"]),
    (r"\b([ab]c)\b", []), (r"\b(colou?r|x)\b", []), (r"\b(colou?rs)\b", ["colo"]), (r"no group", []), (r"\b(a((b|c)d)efg)\b", ["efg"])])
def test_anchor_words(regex, want):
    assert literal_anchors(regex) == want


def test_label_modes(spark):
    df = spark.createDataFrame([("Quito",), ("Q42",), ("",), ("Rom",)], "a string")
    assert [r["a"] for r in resolved_labels(df, "a").collect()] == ["Quito", "Rom"]
    assert [r["a"] for r in resolved_labels(df, "a", mode="broad").collect()] == ["Rom"]


def test_seed_tables(spark):
    tables = seeds.seed_tables(spark)
    assert tables["techniques"].count() == 19 and tables["patterns"].select("technique").distinct().count() == 11
    assert tables["myths"].filter("popularity is null").count() == 1


def test_model_separates_and_rules_rule_without_it(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(i % 2), float(i)] + [0.0] * 4), i % 2 == 1) for i in range(60)]
    examples = ML.training_examples(spark.createDataFrame(rows, ["features", "is_correct"]))
    model = ML.train_confidence(examples)
    scored = ML.score_confidence(examples, F.lit(0.5), model)
    assert ML.accuracy(scored).first()["training_accuracy"] > 0.9
    plain = ML.score_confidence(examples, F.lit(0.42)).first()
    assert plain["confidence"] == plain["lr_score"] == 0.42
    with pytest.raises(ValueError):
        ML.train_confidence(examples.limit(10))


def test_training_computes_its_examples_once(spark):
    """Both fits read the examples several times; a row is computed once all the same."""
    from pyspark.ml.linalg import Vectors

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(float(i % 2), float(i)) for i in range(60)]
    counting = spark.createDataFrame(rows, "label double, x double").mapInPandas(counted, "label double, x double")
    vector = F.udf(lambda a, b: Vectors.dense([a, b, 0.0, 0.0, 0.0, 0.0]), VectorUDT())
    ML.train_confidence(counting.select(vector("label", "x").alias("features"), "label", F.lit(1.0).alias("weight")))
    assert seen.value == 60
