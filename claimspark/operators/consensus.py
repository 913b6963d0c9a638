"""Consensus over repeated extractions, extraction quality and differences.

nodes: ``claim_id, run_id, ordinal, node_type, name, confidence, ...``;
rels: ``claim_id, run_id, ordinal, source_name, relation_type, target_name, confidence, ...``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_key() -> Column:
    return F.concat(F.col("node_type"), F.lit(":"), F.lower("name"))


def rel_key() -> Column:
    return F.concat(F.lower("source_name"), F.lit(":"), F.col("relation_type"), F.lit(":"), F.lower("target_name"))


def _agree(df: DataFrame, key: Column, runs: int, theta: float, strict: bool) -> DataFrame:
    """Best-confidence representative of each key seen often enough; copies combine map-side."""
    needed = math.ceil(runs * theta - 1e-9) if strict else int(runs * theta)
    seen = F.count_distinct("run_id") if strict else F.count(F.lit(1))
    first_best = F.struct(F.col("confidence").alias("c"), (-F.col("run_id")).alias("r"), (-F.col("ordinal")).alias("o"))
    best = df.groupBy("claim_id", key.alias("key")).agg(
        seen.alias("n_seen"), F.max_by(F.struct(*[c for c in df.columns if c != "claim_id"]), first_best).alias("best"))
    return best.filter(F.col("n_seen") >= needed)


def consensus(nodes: DataFrame, rels: DataFrame, n: int, theta: float = 0.6, strict: bool = False
              ) -> tuple[DataFrame, DataFrame]:
    """Nodes and relationships that at least ``int(n * theta)`` of ``n`` runs agree on.

    Node confidence is scaled by half plus half the agreement. ``strict`` rounds the bound up and
    counts distinct runs.
    """
    agreed = _agree(nodes, node_key(), n, theta, strict)
    scaled = (F.col("best.confidence") * (F.lit(0.5) + F.col("n_seen") / n * 0.5)).alias("confidence")
    keep = [c for c in nodes.columns if c not in ("claim_id", "confidence")]
    out_nodes = agreed.select("claim_id", "key", "n_seen", *[F.col(f"best.{c}") for c in keep], scaled)
    out_rels = _agree(rels, rel_key(), n, theta, strict).select("claim_id", "key", "n_seen", "best.*")
    return out_nodes, out_rels


def key_sets(pred: DataFrame, truth: DataFrame, key: Column) -> DataFrame:
    """Distinct keys of both sides per claim with ``side`` tp, fp or fn."""
    p = pred.select("claim_id", key.alias("key"), F.lit(1).alias("p"), F.lit(0).alias("t"))
    t = truth.select("claim_id", key.alias("key"), F.lit(0).alias("p"), F.lit(1).alias("t"))
    both = p.unionByName(t).groupBy("claim_id", "key").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    return both.select("claim_id", "key", F.when((F.col("p") == 1) & (F.col("t") == 1), "tp").when(
        F.col("p") == 1, "fp").otherwise("fn").alias("side"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _rates(sets: DataFrame, prefix: str) -> DataFrame:
    counts = sets.groupBy("claim_id").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rates = counts.withColumns({"p": _share(tp, tp + fp), "r": _share(tp, tp + fn), "h": _share(fp, tp + fp)})
    f1 = _share(F.col("p") * F.col("r") * 2, F.col("p") + F.col("r"))
    return rates.select("claim_id", F.col("p").alias(f"{prefix}_precision"), F.col("r").alias(f"{prefix}_recall"),
                        f1.alias(f"{prefix}_f1"), F.col("h").alias(f"{prefix}_false_share"))


def extraction_metrics(pred_nodes: DataFrame, pred_rels: DataFrame, true_nodes: DataFrame, true_rels: DataFrame) -> DataFrame:
    """Precision, recall and F1 of nodes and relationships, hallucination rate, mean F1 per claim."""
    n = _rates(key_sets(pred_nodes, true_nodes, node_key()), "node")
    r = _rates(key_sets(pred_rels, true_rels, rel_key()), "relationship").drop("relationship_false_share")
    joined = n.join(r, "claim_id", "full_outer").fillna(0.0)
    return joined.withColumn("overall_f1", (F.col("node_f1") + F.col("relationship_f1")) / 2).withColumnRenamed(
        "node_false_share", "hallucination_rate")


def diff_extractions(a: DataFrame, b: DataFrame, attributes: list[str]) -> DataFrame:
    """Compare two node tables by claim and key: agreement, only_left, only_right or conflict.

    The first row (by ordinal) of a key counts; a conflict names the attributes that differ.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("claim_id", node_key().alias("key")).agg(
            F.min_by(F.struct(*attributes), "ordinal").alias(name))

    both = side(a, "l").join(side(b, "r"), ["claim_id", "key"], "full_outer")
    differing = F.filter(F.array(*[
        F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in attributes]), lambda x: x.isNotNull())
    return both.select(
        "claim_id", "key",
        F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right")
        .when(F.size(differing) > 0, "conflict").otherwise("agreement").alias("outcome"),
        F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), differing).otherwise(
            F.array().cast("array<string>")).alias("differing"))
