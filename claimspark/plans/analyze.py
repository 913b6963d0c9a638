"""Text to analysis: language, known myth, claim statuses, verdict; and combined credibility."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import (detect_language, input_type, interpretation_text, level_text,
                                       rule_score_text, with_text_features)
from claimspark.operators import features as feat
from claimspark.operators.evidence import aggregate_sources, article_verdict, credibility
from claimspark.operators.ml import TEXT_WEIGHTS, score_confidence
from claimspark.operators.myths import myth_analysis
from claimspark.operators.propaganda import with_propaganda
from claimspark.session import checkpoint

# Texts of the three verdicts drawn from claim statuses.
_EXPLAIN = {
    "false": ("At least one claim is false.", "The analysis identified false claims."),
    "historically_accurate": ("All claims confirmed.", "The statements are historically correct."),
    "unverifiable": ("Not all statements could be verified.", "Some statements could not be verified."),
}


def analyze_texts(texts: DataFrame, myths: DataFrame, statuses: DataFrame, **options) -> DataFrame:
    """Analysis per ``texts(claim_id, text)``; ``statuses(claim_id, fact_status)`` judges texts that are no known myth."""
    spoken = texts.withColumn("language", detect_language(F.col("text")))
    keep = ["claim_id", "language", "overall_verdict", "verdict_explanation", "summary_for_users", "recommendation", "myth_id"]
    known = myth_analysis(spoken, myths, **options).select(*keep, F.lit("claim").alias("input_type"), F.lit(1).cast("bigint").alias("claims_found"))
    known = checkpoint(known, "known-myths")  # part of the result and what the rest is told by; matching is the costly step
    rest = spoken.join(known.select("claim_id"), "claim_id", "left_anti")
    verdicts = article_verdict(rest.select(F.col("claim_id").alias("article_id")),
                               statuses.withColumnRenamed("claim_id", "article_id")).withColumnRenamed("article_id", "claim_id")
    says = lambda i: F.create_map(*[x for k, v in _EXPLAIN.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("verdict")]
    judged = rest.join(verdicts, "claim_id").select(
        "claim_id", "language", F.col("verdict").alias("overall_verdict"), says(0).alias("verdict_explanation"),
        says(1).alias("summary_for_users"), F.lit(None).cast("string").alias("recommendation"),
        F.lit(None).cast("string").alias("myth_id"), input_type(F.col("text")).alias("input_type"),
        F.greatest(F.lit(1), F.col("n_claims")).cast("bigint").alias("claims_found"))
    return known.unionByName(judged)


def score_texts(texts: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Text features, confidence with level, interpretation and top factors."""
    rows = with_text_features(texts)
    if model is not None:
        rows = feat.with_vector(rows, feat.TEXT_VECTOR)
    scored = score_confidence(rows, rule_score_text(), model, TEXT_WEIGHTS)
    return scored.withColumns({
        "confidence_level": level_text(F.col("confidence")),
        "interpretation": interpretation_text(F.col("confidence")),
        "top_factors": feat.top_factors_text(),
    })


def credibility_report(texts: DataFrame, source_results: DataFrame | None = None, propaganda: bool = True) -> DataFrame:
    """Confidence, propaganda and verification per text and their weighted overall assessment."""
    rows = score_texts(texts)
    rows = with_propaganda(rows) if propaganda else rows.withColumn("propaganda_score", F.lit(None).cast("double"))
    return credibility(rows, aggregate_sources(source_results) if source_results is not None else None)
