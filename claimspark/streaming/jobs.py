"""Structured Streaming jobs. Each one reuses the batch operator of the same name.

Watermarks and trigger sizes are parameters of ours: state needs a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from claimspark import schema as S
from claimspark.functions.names import text_hash
from claimspark.functions.text import level_text, rule_score_text, with_text_features
from claimspark.operators import kb as K
from claimspark.operators.batch import request_key
from claimspark.operators.ml import MIN_EXAMPLES_TEXT, save_model, train_confidence
from claimspark.operators.propaganda import with_propaganda
from claimspark.sources.files import append_facts


def stream_facts(spark: SparkSession, path: str, schema: str = S.FACTS, max_files: int = 100, fmt: str = "json") -> DataFrame:
    """New files of a folder in bounded steps; the query's checkpoint is the offset, moved only by a finished batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def stream_dedup(claims: DataFrame, ttl: str = "24 hours", text: str = "text", ts: str = "ts") -> DataFrame:
    """First claim per text hash within the TTL."""
    hashed = claims.withColumns({"text_hash": text_hash(F.col(text)), "_digest": F.sha2(F.col(text), 256)})
    return hashed.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def stream_progress(items: DataFrame, ts: str = "ts", watermark: str = "10 minutes", seconds: int = 60) -> DataFrame:
    """Per window of ``seconds``: processed, successful and failed items, and the processed ones per minute."""
    s = F.col("status")
    return items.withWatermark(ts, watermark).groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(
        F.count_if(s.isin("success", "failed", "skipped")).alias("processed"), F.count_if(s == "success").alias("successful"),
        F.count_if(s == "failed").alias("failed")).select(F.col("w.start").alias("minute"), "processed", "successful", "failed",
                                                            (F.col("processed") * 60.0 / seconds).alias("rate_per_minute"))


def stream_rate(events: DataFrame, key: str, ts: str = "ts", seconds: int = 60, slide: int = 10, watermark: str = "10 minutes") -> DataFrame:
    """Requests per key in sliding windows."""
    return events.withWatermark(ts, watermark).groupBy(
        key, F.window(ts, f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")


class ReuseProcessor(StatefulProcessor):
    """Keeps one anchor time per key; a request is a hit while it is younger than the TTL.

    A timer clears the state one TTL after the watermark passes the anchor.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True).sort_values(["us", "request_id"], kind="stable", ignore_index=True)
        current = self.anchor.get()[0] if self.anchor.exists() else None
        hits = []
        for us in batch["us"]:
            hit = current is not None and us - current < self.ttl_us
            hits.append(hit)
            if not hit:
                current = int(us)
        self.anchor.update((current,))
        self.handle.registerTimer((current + self.ttl_us) // 1000)
        yield pd.DataFrame({"request_id": batch["request_id"], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.anchor.exists() and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= self.anchor.get()[0] + self.ttl_us - 1000:
            self.anchor.clear()
        yield pd.DataFrame({"request_id": pd.Series(dtype="int64"), "hit": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_reuse(requests: DataFrame, ttl_seconds: int = 86_400, watermark: str = "1 hour") -> DataFrame:
    """Streaming verdict reuse over ``key, ts, request_id (long)``. Needs the RocksDB state store provider.

    Within a batch the requests of a key are put in time order; a request that arrives in a later
    batch than a younger one counts against the anchor of its arrival.
    """
    keyed = requests.withColumns({"k": request_key(F.col("key")), "us": F.unix_micros(F.col("ts").cast("timestamp"))}).withWatermark("ts", watermark)
    return keyed.select("k", "ts", "us", "request_id").groupBy("k").transformWithStateInPandas(
        statefulProcessor=ReuseProcessor(ttl_seconds * 1_000_000), outputStructType="request_id long, hit boolean",
        outputMode="Append", timeMode="EventTime")


def stream_grow_kb(source: DataFrame, kb_path: str, checkpoint: str) -> DataStreamWriter:
    """Append each batch's new facts to the knowledge base; a replayed batch adds nothing twice."""
    def grow(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(S.FACTS).json(kb_path)
        append_facts(K.new_facts(batch, known), kb_path)

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(grow)


def stream_score(texts: DataFrame) -> DataFrame:
    """Confidence and propaganda scores of every arriving text; stateless."""
    rows = with_propaganda(with_text_features(texts))
    score = rule_score_text()
    return rows.withColumns({"confidence": score, "confidence_level": level_text(score)})


def stream_learn(examples: DataFrame, store: str, model_path: str, checkpoint: str, min_examples: int = MIN_EXAMPLES_TEXT) -> DataStreamWriter:
    """Store labelled feature vectors and refit once enough are there.

    ``examples``: ``features, label, weight, source``. Every batch writes its own folder, so a replay
    overwrites instead of doubling.
    """
    def learn(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        gathered = batch.sparkSession.read.parquet(store)
        if gathered.count() >= min_examples:
            save_model(train_confidence(gathered, min_examples), model_path)

    return examples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(learn)


def stream_reviews(events: DataFrame, candidates_path: str, out_path: str, checkpoint: str) -> DataStreamWriter:
    """Apply review events to the candidate queue; all events are kept, so the latest always wins."""
    def review(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out_path}/events/epoch={epoch}")
        seen = spark.read.parquet(f"{out_path}/events")
        queue = spark.read.schema(S.CANDIDATES).json(candidates_path)
        K.apply_reviews(queue, seen).write.mode("overwrite").json(f"{out_path}/candidates")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(review)
