"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Class k holds the pieces of length ``floor(capacity / (k + 1)) < n <= floor(capacity / k)`` and every bin of
class k takes exactly k of them. A piece enters its class only if k such pieces leave at most ``slack`` ids
of the bin free; a longer rest gives off a piece of the exact length of the next class first. So padding
is at most ``slack`` ids a sequence, and each partition fills its own bins without any exchange of rows.

The bins that are open when a partition ends are emptied into one stream that is cut anew into full
sequences; what is left below a full one is cut into lengths that are powers of two, which need no padding.

Null texts count as empty, so they yield the closing id alone. Repeated rows and equal ids are packed
once for every row. Null ids stay null. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import text_slices
from claimspark.llm.tokenids import text_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CACHE_WORDS = 900_000  # words of each of the encoder's two generations, together about 400 MB in a Python worker
PARTITION_SHIFT = 33  # sequence ids: partition number above, count within the partition below

Piece = tuple  # (doc_id, start, length, crc, doc_tokens)


def cut(n: int, capacity: int, slack: int) -> Iterator[tuple[int, int]]:
    """(length, class) of the pieces of a document of n ids, in order."""
    while n >= capacity:
        yield capacity, 1
        n -= capacity
    while n > 0:
        k = capacity // n
        if capacity - k * n <= slack:
            yield n, k
            return
        part = capacity // (k + 1)
        yield part, k + 1
        n -= part


class Bins:
    """Open bins of one partition; ``rows`` holds the pieces of closed sequences."""

    def __init__(self, first_sequence: int, capacity: int, slack: int):
        self.capacity, self.slack, self.next = capacity, slack, first_sequence
        self.open: dict[int, list[tuple[Piece, bytes]]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple[Piece, bytes]]) -> None:
        offset = 0
        for piece, _ in pieces:
            self.rows.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        for length, k in cut(total, self.capacity, self.slack):
            part = ids[4 * at:4 * (at + length)]
            bin_ = self.open.setdefault(k, [])
            bin_.append(((doc_id, at, length, zlib.crc32(part), total), part))
            if len(bin_) == k:
                self._close(self.open.pop(k))
            at += length

    def finish(self) -> None:
        """Cut what is in open bins into full sequences and, at the end, into powers of two."""
        rest = [entry for k in sorted(self.open) for entry in self.open[k]]
        self.open.clear()
        left = sum(piece[2] for piece, _ in rest)
        current: list[tuple[Piece, bytes]] = []
        size, filled = 0, 0
        for (doc_id, start, length, crc, total), part in rest:
            at = 0
            while at < length:
                if not size:
                    size, filled = (self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)), 0
                take = min(length - at, size - filled)
                ids = part[4 * at:4 * (at + take)]
                current.append(((doc_id, start + at, take, crc if take == length else zlib.crc32(ids), total), ids))
                at, filled, left = at + take, filled + take, left - take
                if filled == size:
                    self._close(current)
                    current, size = [], 0


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, slack: int = 32, end_id: int = 1,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence at which offset.

    ``capacity`` must be a power of two. Memory of a task: one batch of texts, and fewer than
    ``capacity`` ids for every class in use.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer_path, CACHE_WORDS)
        bins = Bins(TaskContext.get().partitionId() << PARTITION_SHIFT, capacity, slack)

        def out() -> pa.RecordBatch:
            columns = list(zip(*bins.rows)) or [[] for _ in range(7)]
            bins.rows = []
            names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in text_slices(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                bins.add(doc_id, ids + end)
            yield out()
        bins.finish()
        yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
