"""Joins that stay balanced when a few keys hold much of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.002  # a key is hot from this share of the rows on
TRACKED = 4096  # counters of the sketch; more than 1 / HOT_SHARE of them cannot miss a hot key
SALTS = 64


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows, by one pass of a frequent-items sketch.

    The sketch tracks ``TRACKED`` counters per task and overestimates a count by at most its share of a
    counter, so no hot key is missed and the list has at most ``2 / share`` entries whatever the size of the table.
    Rows with a null key match nothing and are not counted.
    """
    code = F.xxhash64(*keys)
    known = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(code.alias("_code"))
    row = known.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_code, {int(2 / share)}, {TRACKED})").alias("top")).first()
    return sorted(t["item"] for t in row["top"] or [] if t["count"] >= share * row["n"] and t["count"] > SALTS)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: list[int] | None = None, salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``; the rows of a hot key of ``left`` are dealt over ``salts`` tasks.

    Only the hot keys' rows of ``right`` are copied, once per salt; all other rows of both sides are shuffled once and
    unchanged. ``how``: inner, left, left_semi or left_anti. The keys found by ``hot_keys`` may be passed on for
    several joins. Null keys match nothing; those of ``left`` are dealt by a salt of their own, so they never gather.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not possible with copied rows: {how}")
    hot = hot_keys(left, keys) if hot is None else hot
    empty = F.lit(False)
    for key in keys:
        empty = empty | F.col(key).isNull()
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    spread = F.pmod(F.xxhash64(*(F.col(c) for c, t in left.dtypes if not t.startswith("map"))), F.lit(salts)).cast("int")
    left_salt = F.when(empty | is_hot, spread).otherwise(F.lit(0))
    right_salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = left.withColumn("_salt", left_salt)
    copied = right.filter(~empty).withColumn("_salt", F.explode(right_salts))
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
