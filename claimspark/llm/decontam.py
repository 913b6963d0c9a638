"""Benchmark passages in documents, found with the q-gram lemma and confirmed by banded alignment.

An item of m characters may differ from a passage by k = floor(rate * m) edits. By the lemma such a passage shares at
least m - q + 1 - q * k q-grams with the item, and they lie within k + 1 neighbouring diagonals. Diagonals are cut
into bands of 2 * (k + 1) that overlap by half, so some band holds them all. A band with fewer shared q-grams cannot
hold a passage; the others are aligned within their band. Nothing is lost by the count filter.

The benchmark is a stated set of queries: it is read in blocks of at most ``block_chars`` characters, whose index
is sent to the tasks, and every block meets all documents. Documents are never shuffled.

Comparison ignores letter case. Null texts match nothing; null items, and items shorter than q characters, match
nothing either. Where rate * m edits would leave no q-gram to count on, k is the largest that leaves one. Items that repeat
a text give one result each, rows that repeat an id as well. Very long texts are scanned whole, once. Empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import text_slices

Q, RATE = 8, 0.08
BLOCK_CHARS = 4_000_000
BITS = 22
FACTOR = np.uint32(0x01000193)

HITS = "doc_id long, item_id long, start long, end long, edits long"


def lowered(text: str) -> str:
    """Lower case with one character for each of the text, so positions stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


PADDING = 0xFFFFFFFF  # no code point


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    out = np.zeros(n, dtype=np.uint32)
    for j in range(q):
        out *= FACTOR
        out ^= chars[j:j + n]
    out ^= out >> np.uint32(15)
    return out * np.uint32(0x85EBCA6B)


def banded_distance(item: np.ndarray, region: np.ndarray, width: int) -> tuple[int, int]:
    """Fewest edits from the whole item to a piece of the region that starts on one of ``width`` diagonals
    and stays on them; the end of that piece."""
    m = len(item)
    padded = np.full(m + width, -1, dtype=np.int64)
    padded[:min(len(region), m + width)] = region[:m + width]
    steps = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    inside = len(region)
    for i in range(1, m + 1):
        step = row + (padded[i - 1:i - 1 + width] != item[i - 1])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
    row = np.where(m + steps <= inside + 0, row, row + np.maximum(0, m + steps - inside))
    best = int(row.argmin())
    return int(row[best]), min(m + best, inside)


@dataclass
class Index:
    """The q-grams of a block of items, sorted, with where they occur."""

    ids: list[int | None]
    items: list[str]
    chars: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    item_of: np.ndarray
    offset_of: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], q: int, rate: float) -> Index:
        items = [lowered(t) for _, t in rows]
        chars = [codes(t) for t in items]
        lengths = np.array([len(c) for c in chars], dtype=np.int64)
        budget = np.minimum(np.floor(rate * lengths + 1e-9).astype(np.int64), (lengths - q) // q)
        hashes = [gram_hashes(c, q) for c in chars]
        flat = np.concatenate(hashes)
        item_of = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        offset_of = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(flat, kind="stable")
        grams, starts = np.unique(flat[order], return_index=True)
        bitmap = np.zeros(1 << BITS, dtype=bool)
        bitmap[grams >> np.uint32(32 - BITS)] = True
        return cls([i for i, _ in rows], items, chars, budget, lengths - q + 1 - q * budget, grams,
                   np.append(starts, len(flat)), item_of[order], offset_of[order], bitmap)

    def search(self, text: str, q: int) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the passages of a text, the best of overlapping ones."""
        low = lowered(text)
        chars = codes(low)
        hashes = gram_hashes(chars, q)
        at = np.flatnonzero(self.bitmap[hashes >> np.uint32(32 - BITS)])
        if not len(at):
            return []
        slot = np.searchsorted(self.grams, hashes[at])
        slot[slot == len(self.grams)] = 0
        good = self.grams[slot] == hashes[at]
        at, slot = at[good], slot[good]
        count = self.starts[slot + 1] - self.starts[slot]
        if not count.sum():
            return []
        posting = np.repeat(self.starts[slot] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        item = self.item_of[posting]
        half = self.budget[item] + 1
        band = (np.repeat(at, count) - self.offset_of[posting]) // half
        shift = np.int64(1) << np.int64(32)
        keys, shared = np.unique(np.concatenate([item * shift + (band + (shift >> 1)), item * shift + (band - 1 + (shift >> 1))]), return_counts=True)
        item, band = keys // shift, keys % shift - (shift >> 1)
        passed = shared >= self.least[item]
        found: list[tuple[int, int, int, int]] = []
        for i, b in zip(item[passed].tolist(), band[passed].tolist()):
            k, m = int(self.budget[i]), len(self.chars[i])
            start, width = b * (k + 1), 2 * (k + 1)
            first = max(0, start)
            exact = low.find(self.items[i], first, max(first, start + width - 1 + m))
            if exact >= 0:
                edits, end = 0, exact + m
            else:  # before the text's first character lies padding that equals nothing, so an item may lack its first characters there
                region = chars[first:max(first, start + width + m)]
                if start < 0:
                    region = np.concatenate([np.full(-start, PADDING, dtype=region.dtype), region])
                edits, end = banded_distance(self.chars[i], region, width)
                end += start
            if edits <= k:
                found.append((i, max(0, end - m), end, edits))
        best: list[tuple[int, int, int, int]] = []
        for hit in sorted(found, key=lambda h: (h[0], h[3], h[1])):
            if not any(hit[0] == o[0] and hit[1] < o[2] and o[1] < hit[2] for o in best):
                best.append(hit)
        return best


def index_blocks(benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS,
                 id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    rows, size = [], 0
    items = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.length(text_col) >= q)
    for item_id, text in items.toLocalIterator():
        if rows and size + len(text) > block_chars:
            yield Index.of(rows, q, rate)
            rows, size = [], 0
        rows.append((item_id, text))
        size += len(text)
    if rows:
        yield Index.of(rows, q, rate)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: doc_id, item_id, its characters start to end (start is exact for edits = 0), edits."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], HITS)
    for index in index_blocks(benchmark, q, rate, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in text_slices(batches):
                rows = [(doc, index.ids[i], start, end, edits) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        if text for i, start, end, edits in index.search(text, q)]
                columns = list(zip(*rows)) or [[] for _ in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split(" ")[0] for c in HITS.split(", ")])

        out = out.unionByName(d.mapInArrow(run, HITS))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns."""
    for index in index_blocks(benchmark, q, rate, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches):
                clean = [not text or not shared.value.search(text, q) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
