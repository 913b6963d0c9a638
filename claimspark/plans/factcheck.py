"""Claim to verdict: knowledge base first, votes of other checkers for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.operators.evidence import merge_votes, verify_pattern_claims, weighted_votes
from claimspark.operators.search import kb_verdicts


def structured_votes(claims: DataFrame, geo_facts: DataFrame) -> DataFrame:
    """Votes from sentence patterns: ``claim_id, ordinal, kind, verdict, explanation``."""
    checked = verify_pattern_claims(claims, geo_facts)
    return checked.select("claim_id", F.lit(1).alias("ordinal"), F.lit("structured").alias("kind"),
                          F.when(F.col("confirms"), "true").otherwise("false").alias("verdict"), "explanation")


def check_claims(claims: DataFrame, kb: DataFrame, votes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One verdict per claim. Claims a knowledge-base hit settles never reach the vote merge.

    ``votes``: ``claim_id, ordinal, kind, raw_confidence, verdict, explanation, correction, claim_type``.
    """
    base = kb_verdicts(claims, kb, threshold)
    settled = base.filter(F.col("verdict").isNotNull())
    labels = F.create_map(*[x for k, v in L.VERDICT_LABELS.items() for x in (F.lit(k), F.lit(v))])
    from_kb = settled.select("claim_id", "verdict", labels[F.col("verdict")].alias("verdict_label"), "confidence", "explanation",
                             "correction", "claim_type", F.lit("kb").alias("decided_by"))
    open_claims = base.filter(F.col("verdict").isNull()).select("claim_id")
    merged = merge_votes(open_claims, weighted_votes(votes).join(open_claims, "claim_id", "left_semi"))
    return from_kb.unionByName(merged.drop("n_votes").withColumn("decided_by", F.lit("votes")))
