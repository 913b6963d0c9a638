"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimspark.session import freed_shuffles as freed_shuffles  # for the operators of this package

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
LOWER_ASCII = {code: code + 32 for code in range(65, 91)}

# The rows that one Arrow batch of a Python stage may hold; texts are long, so batches stay small.
TEXT_BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in zero-copy slices of at most ``rows`` rows, so Python objects of few texts exist at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
