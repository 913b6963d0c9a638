"""Session defaults, the shared checkpoint folder and size-checked driver reads."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Options every job of this library expects; a cluster may override any of them at submit time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "claimspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir`` wins.

    Only a local-mode session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder path next to the checkpoints, visible to all executors.

    All of an application's tables lie in one folder, so they can be removed together at its end.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/claimspark-{spark.sparkContext.applicationId}/{name}-{os.urandom(8).hex()}"


def spread(df: DataFrame, uneven: float = 1.5) -> DataFrame:
    """Spread a scanned table over the cores unless its splits already do so.

    Splits are cut by bytes, but one task reads a Parquet row group whole: a table of few row groups keeps few tasks busy,
    however many splits it has. So the rows of the splits are counted, which reads no columns, and the table is dealt out
    anew if the largest one holds more than ``uneven`` times a core's share. Meant for plain scans.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores:
        sizes = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        rows = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if (rows["most"] or 0) * cores <= (rows["all"] or 0) * uneven:
            return df
    return df.repartition(max(cores, splits))


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, Spark removes the shuffle files of a write when the write is over.

    For chains of jobs that hand over through written tables: the files would stay until the driver collects garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpoint(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    Cuts the lineage like a reliable checkpoint and survives the loss of executors, but runs the
    plan a single time and stores columns, which take less room by zstd. The shuffle files of the plan are gone when
    the table is written.
    """
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_slices(plan: Callable[[Column], DataFrame], rows: DataFrame, key: str, name: str = "table",
                      slice_rows: int = 5_000_000, most: int = 16) -> DataFrame:
    """The union of ``plan(condition)``, written slice by slice, so that the shuffle files of one slice exist at once.

    The conditions part the rows by the hash of ``key``; ``plan`` must give for each what it gives for the rows of these keys.
    ``rows`` is a stored table; there is one slice for every ``slice_rows`` of it, ``most`` at most.
    """
    n = max(1, min(most, rows.count() // slice_rows))
    within = lambda i: F.lit(True) if n == 1 else F.pmod(F.xxhash64(key), F.lit(n)) == i
    return reduce(DataFrame.unionByName, [checkpoint(plan(within(i)), name) for i in range(n)])


def bounded_rows(df: DataFrame, max_rows: int) -> list[Row] | None:
    """All rows if there are at most ``max_rows``, else None.

    Reads ``max_rows + 1`` rows at most, so the driver never holds an unbounded table. Callers
    treat None as "too large to inline" and take their join path.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether the frame has at most ``max_rows`` rows; counts no further than one more."""
    return df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when the side is proven to have at most ``max_rows`` rows."""
    return F.broadcast(df) if bounded(df, max_rows) else df
