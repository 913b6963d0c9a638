"""Batch bookkeeping: duplicates, progress, totals, request rates and verdict reuse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.names import strip, text_hash
from claimspark.operators.skew import skew_join
from claimspark.session import checkpoint

DONE = ("success", "failed", "skipped")


def mark_duplicates(items: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """Status ``queued`` for the first item of each text (by ``item``), ``skipped`` for its copies.

    Texts are told apart by their whole digest; ``text_hash`` is its short form for display.

    The join back runs on the unique item id, not on the hash, so a text that makes up a third of
    the table does not gather in one task.
    """
    hashed = items.withColumn("text_hash", text_hash(F.col(text)))
    first = hashed.groupBy(F.sha2(F.col(text), 256)).agg(F.min(item).alias(item)).select(item, F.lit(True).alias("_first"))
    return hashed.join(first, item, "left").withColumn(
        "status", F.when(F.col("_first"), "queued").otherwise("skipped")).drop("_first")


def batch_progress(items: DataFrame, jobs: DataFrame | None = None, now=None) -> DataFrame:
    """Counts, percent done, rate per minute and remaining seconds per job.

    ``items``: ``job_id, status``; ``jobs``: ``job_id, started_at``. Without start time there is no
    rate (0) and no estimate (null).
    """
    s = F.col("status")
    p = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(s.isin(*DONE)).alias("processed_items"),
        F.count_if(s == "success").alias("successful_items"), F.count_if(s == "failed").alias("failed_items"),
        F.count_if(s == "skipped").alias("skipped_items"))
    p = p.join(jobs.select("job_id", "started_at"), "job_id", "left") if jobs is not None else p.withColumn(
        "started_at", F.lit(None).cast("timestamp"))
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    elapsed = F.unix_micros(clock) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    done, total = F.col("processed_items"), F.col("total_items")
    running = F.col("started_at").isNotNull() & (elapsed > 0)
    return p.withColumns({
        "progress_percent": done / total * 100,
        "current_rate_per_minute": F.when(running, done / (elapsed / 60)).otherwise(0.0),
        "estimated_remaining_seconds": F.when(running & (done > 0), (total - done) / (done / elapsed)),
    })


def batch_result(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals per job, and the failed items as a table of their own (never as one list per job)."""
    totals = items.groupBy("job_id").agg(
        F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("total_nodes"), F.coalesce(F.sum("n_rels"), F.lit(0)).alias("total_relationships"),
        F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"), F.count_if(F.col("status") == "failed").alias("failed_items"))
    failed = items.filter(F.col("status") == "failed").select("job_id", "item_id", "error", "source_id")
    return totals, failed


def import_stats(results: DataFrame) -> DataFrame:
    """Totals over successful imports: ``query, success, nodes, relationships``."""
    ok = F.col("success")
    return results.agg(
        F.coalesce(F.sum(F.when(ok, F.col("nodes"))), F.lit(0)).alias("total_nodes_imported"),
        F.coalesce(F.sum(F.when(ok, F.col("relationships"))), F.lit(0)).alias("total_relationships_imported"),
        F.count_distinct("query").alias("queries_processed"))


def rolling_rate(events: DataFrame, key: str, ts: str = "ts", seconds: int = 60, limit: int = 60,
                 bucket_seconds: int = 600) -> DataFrame:
    """Append how many requests of the key fall in the last ``seconds`` and whether that is over the limit.

    Windows are cut into (key, time bucket) pieces; a row near the end of its bucket is also handed
    to the next one as context. A hot key therefore spreads over as many tasks as it has buckets.
    """
    span, width = seconds * 1_000_000, max(bucket_seconds, seconds) * 1_000_000
    df = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    own = F.floor(F.col("_us") / width)
    tail = F.col("_us") >= (own + 1) * width - span
    copies = F.when(tail, F.array(F.struct(own.alias("b"), F.lit(True).alias("own")),
                                  F.struct((own + 1).alias("b"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(own.alias("b"), F.lit(True).alias("own"))))
    w = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-span + 1, 0)
    rated = df.withColumn("_x", F.explode(copies)).withColumns({"_b": F.col("_x.b"), "_own": F.col("_x.own")}).drop("_x")
    rated = rated.withColumn("requests_in_window", F.count(F.lit(1)).over(w)).filter("_own")
    return rated.withColumn("over_limit", F.col("requests_in_window") > limit).drop("_us", "_b", "_own")


# ---- verdict reuse -----------------------------------------------------------------------------
def request_key(text, trimmed: bool = True):
    return F.md5(strip(F.lower(text)) if trimmed else F.lower(text))


def _scan_misses(ttl_us: int, inclusive: bool):
    side = "right" if inclusive else "left"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walk partitions sorted by key and time; only the current key's anchor is kept."""
        key, expiry = None, 0
        for batch in batches:
            keys, times = batch["_k"].to_numpy(), batch["_us"].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            misses = []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                i = lo
                if keys[lo] == key:
                    i = lo + np.searchsorted(times[lo:hi], expiry, side)
                while i < hi:
                    misses.append(i)
                    key, expiry = keys[i], times[i] + ttl_us
                    i = lo + np.searchsorted(times[lo:hi], expiry, side)
            yield batch.iloc[misses]

    return scan


def _next_misses(times: DataFrame, ttl_us: int, inclusive: bool) -> DataFrame:
    """``_k``, ``_us``, ``_next``: for every time the first one of its key past its expiry, null if there is none.

    Times and expiries are merged within (key, bucket), a bucket being a small part of the TTL; where a bucket holds no later
    time, the next bucket in use answers with its first one. So a hot key spreads over as many tasks as it has buckets.
    """
    width = max(1, ttl_us // 64)
    ask = F.col("_us") + ttl_us + (1 if inclusive else 0)
    none = F.lit(None).cast("long")
    both = times.select("_k", F.col("_us").alias("_at"), F.col("_us").alias("_time"), none.alias("_from")).unionByName(
        times.select("_k", ask.alias("_at"), none.alias("_time"), F.col("_us").alias("_from")))
    later = Window.partitionBy("_k", "_bucket").orderBy(F.desc("_at"), F.col("_from").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    asked = both.withColumn("_bucket", F.floor(F.col("_at") / width)).withColumn("_found", F.min("_time").over(later)).filter("_from IS NOT NULL")
    asked = checkpoint(asked.select("_k", "_bucket", F.col("_from").alias("_us"), "_found"), "expiries")
    firsts = times.groupBy("_k", F.floor(F.col("_us") / width).alias("_bucket")).agg(F.min("_us").alias("_first"))
    open_ends = asked.filter("_found IS NULL").select("_k", "_bucket").distinct()
    beyond = Window.partitionBy("_k").orderBy(F.desc("_bucket"), F.col("_first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rest = open_ends.withColumn("_first", none).unionByName(firsts).withColumn("_later", F.min("_first").over(beyond)).filter("_first IS NULL")
    rest = rest.select("_k", "_bucket", "_later")
    return skew_join(asked, rest, ["_k", "_bucket"], "left").select("_k", "_us", F.coalesce("_found", "_later").alias("_next"))


def _chained_anchors(times: DataFrame, ttl_us: int, inclusive: bool) -> DataFrame:
    """The misses ``_k``, ``_us`` of every key: what its first time reaches over next-miss pointers.

    Pointers are doubled: after round i they span 2**i misses and all those within that reach are known. Rounds are logarithmic in
    the misses of a key, each a written table. Only times that some pointer names can be misses, so only they keep one.
    """
    pointers = checkpoint(_next_misses(times, ttl_us, inclusive).filter("_next IS NOT NULL"), "pointers")
    reached = checkpoint(times.groupBy("_k").agg(F.min("_us").alias("_us")), "anchors")
    named = reached.union(pointers.select("_k", "_next")).distinct()
    pointers = checkpoint(pointers.join(named, ["_k", "_us"], "left_semi"), "pointers")
    while not pointers.isEmpty():
        ahead = reached.join(pointers, ["_k", "_us"]).select("_k", F.col("_next").alias("_us"))
        reached = checkpoint(reached.union(ahead), "anchors")
        onward = pointers.select("_k", F.col("_us").alias("_next"), F.col("_next").alias("_after"))
        pointers = checkpoint(skew_join(pointers, onward, ["_k", "_next"]).select("_k", "_us", F.col("_after").alias("_next")), "pointers")
    return reached


def reuse_flags(requests: DataFrame, ttl_seconds: int = 86_400, key: str = "key", ts: str = "ts", request_id: str = "request_id",
                inclusive: bool = False, trimmed: bool = True, hot_rows: int = 5_000_000) -> DataFrame:
    """Append ``hit``: whether a verdict younger than the TTL existed for the normalised key.

    The clock restarts on a miss only; a hit does not refresh it. ``inclusive`` counts an age of
    exactly the TTL as a hit. Ordinary keys are walked in sorted partitions, one pass each. Keys with more than
    ``hot_rows`` distinct times go through next-miss pointers instead, however long their log is.
    """
    ttl = ttl_seconds * 1_000_000
    keyed = requests.withColumns({"_k": request_key(F.col(key), trimmed), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})
    times = keyed.groupBy("_k", "_us").agg(F.min(request_id).alias("_first"))
    hot_keys = times.groupBy("_k").count().filter(F.col("count") > hot_rows).select("_k")
    cold, anchors = times, None
    if not hot_keys.isEmpty():
        hot_keys = checkpoint(hot_keys)
        hot = checkpoint(times.join(hot_keys, "_k", "left_semi"), "hot-times")
        cold = times.join(hot_keys, "_k", "left_anti")
        anchors = _chained_anchors(hot.select("_k", "_us"), ttl, inclusive).join(hot, ["_k", "_us"])
    walked = cold.select("_k", "_us", "_first").repartition("_k").sortWithinPartitions("_k", "_us").mapInPandas(
        _scan_misses(ttl, inclusive), cold.select("_k", "_us", "_first").schema)
    misses = walked if anchors is None else walked.unionByName(anchors.select("_k", "_us", "_first"))
    # Joined on the unique request id, so a hot key is no hot join key.
    missed = misses.select(F.col("_first").alias(request_id), F.lit(True).alias("_miss"))
    return keyed.drop("_k", "_us").join(missed, request_id, "left").withColumn("hit", F.col("_miss").isNull()).drop("_miss")


def reuse_stats(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
                       (F.avg(F.col("hit").cast("double")) * 100).alias("hit_rate"))
