"""Removal of repeated byte strings: every byte under a ``LENGTH``-byte string that also starts earlier goes.

Earlier means in a smaller document id, or further left in the same document; matches never cross documents and are
judged on the input. The work follows the suffix sorting of a difference cover: a sample of positions is named by
sorting, every other start is named through its offset to a sampled position, naming is repeated on finer pieces where a
coarse name does not decide, and neighbours in the sorted order are compared.

Cover. Any two equal strings need a sampled position at the same offset. Residue classes modulo v guarantee this
with 1/sqrt(v) of all positions; here the position of the smallest hash among the ``GRAM``-byte grams of a string is taken,
which depends on the string alone and samples about 2 / (LENGTH - GRAM + 2) of them, some 3 %.
1. Starts that share a sampled position form a block. Blocks are named by the hash of the sampled gram and of all bytes
   under the block, and sorted by name, document and place. In a run of equal names every block but the first is removed
   whole: all its starts occur earlier.
2. Where a gram has blocks of different names, the first block of each name is cut into cells of ``CELL`` starts at fixed
   offsets from the sampled position. Cells are named by the bytes that all their starts share (the core) and by all
   bytes under the cell, sorted, and treated alike. Later blocks need no look, as their starts are in the first.
3. Where a core has cells of different names, the starts of the first cell of each name are named by the core and the
   bytes around it, sorted, and removed unless first.
Names are 128 bits (two 64-bit hashes). Each task names and removes repeats within what it holds before anything is
shuffled, so a passage with a third of all rows reaches the sort as one row per task; the sorted runs are read as a
stream that remembers one row.

Null and empty texts, and texts shorter than ``LENGTH`` bytes, keep all. Rows that repeat id and text are one document and give
equal rows; rows that repeat an id with other texts are ordered by digest; null ids come first. Texts of any length are
read in pieces. Empty tables give no rows. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import freed_shuffles, text_slices
from claimspark.llm.shingles import mix, powers
from claimspark.session import checkpoint

LENGTH, GRAM, CELL = 100, 32, 16
PIECE = 1 << 20  # starts handled at once
FLUSH = 400_000  # names a task holds before it removes repeats among them and sends on the rest
POSITION_BITS = np.uint64(31)
POSITION_MASK = np.uint64((1 << 31) - 1)
LOW = 255  # a place: first start << 16 | sampled position - first start << 8 | last start - first start

ROWS = "name long, second long, doc long, at long"
REPEATS = "doc long, at long, name long, whole boolean"


class Prefix:
    """Hashes of any substring of a byte array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def place_of(first: np.ndarray, offset: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (first << 16) | (offset << 8) | span


def blocks(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, second, place) of the blocks of a text, piece by piece.

    A block that the end of a piece cuts has another name than its copies, so it is looked at in cells.
    """
    for begin in range(0, len(data) - length + 1, PIECE):
        part = data[begin:begin + PIECE + length - 1]
        prefix = Prefix(part)
        at = np.arange(len(part) - gram + 1)
        grams = prefix.of(at, at + gram)
        ranked = (grams & ~POSITION_MASK) | at.astype(np.uint64)
        chosen = (sliding_min(ranked, length - gram + 1) & POSITION_MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:], [len(chosen)]]) - 1
        sampled = chosen[first]
        second = mix(prefix.of(first, last + length) + (sampled - first).astype(np.uint64) * np.uint64(0x9E3779B1) + (last - first).astype(np.uint64))
        yield grams[sampled], second | np.uint64(1), place_of(first + begin, sampled - first, last - first)


def split_repeats(name: np.ndarray, second: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first row of every name, and of the others."""
    order = np.lexsort((at, doc, second, name))
    n, s = name[order], second[order]
    first = np.concatenate([[True], (n[1:] != n[:-1]) | (s[1:] != s[:-1])]) if len(order) else np.zeros(0, dtype=bool)
    return order[first], order[~first]


def cells(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(name, second, place, surroundings) of the cells of some blocks: the core, the whole cell, and the bytes within
    CELL - 1 of the core on either side."""
    first, offset, span = places >> 16, (places >> 8) & LOW, places & LOW
    low, high = (offset - span) // CELL, offset // CELL
    n = high - low + 1
    which = np.repeat(np.arange(len(places)), n)
    cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
    sampled = (first + offset)[which]
    far, near = np.minimum(CELL * cell + CELL - 1, offset[which]), np.maximum(CELL * cell, (offset - span)[which])
    prefix, core = Prefix(data), sampled - CELL * cell
    core_end = core - CELL + 1 + length
    name = prefix.of(core, core_end) + cell.astype(np.uint64)
    second = mix(prefix.of(sampled - far, sampled - near + length) + far.astype(np.uint64) * np.uint64(0x9E3779B1) + near.astype(np.uint64)) | np.uint64(1)
    padded = np.concatenate([np.zeros(CELL - 1, dtype=np.uint8), data, np.zeros(CELL - 1, dtype=np.uint8)])
    steps = np.arange(CELL - 1)
    around = np.concatenate([padded[core[:, None] + steps], padded[(core_end + CELL - 1)[:, None] + steps]], axis=1)
    return mix(name), second, place_of(sampled - far, far, far - near), around


def starts(name: np.ndarray, place: np.ndarray, around: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, second, place, index of its cell) of the single starts of some cells."""
    far, span = (place >> 8) & LOW, place & LOW
    for left in range(CELL):
        offset = far // CELL * CELL + left
        at = np.flatnonzero((offset <= far) & (offset >= far - span))
        own = np.zeros((len(at), 16), dtype=np.uint8)
        own[:, :CELL - 1] = np.concatenate([around[at, CELL - 1 - left:CELL - 1], around[at, CELL - 1:2 * (CELL - 1) - left]], axis=1)
        low, high = own.view("<u8")[:, 0], own.view("<u8")[:, 1]
        core = name[at]
        yield (mix(core + mix(low) + mix(high + np.uint64(left + 1))), mix(core * np.uint64(0x9E3779B1) + mix(high) + low * np.uint64(0xC2B2AE35) + np.uint64(left)) | np.uint64(1),
               ((place[at] >> 16) + far[at] - offset[at]) << 16, at)


def batch_of(name, second, doc, at, around=None) -> pa.RecordBatch:
    """The first of equal names, to be sorted, and the others as known repeats: second = 0, under a name of their own."""
    first, rest = split_repeats(name, second, doc, at)
    own = mix(doc[rest].astype(np.uint64) * np.uint64(0x9E3779B1) + at[rest].astype(np.uint64))
    order = np.concatenate([first, rest])
    columns = [np.concatenate([name[first], own]).view(np.int64), np.concatenate([second[first], np.zeros(len(rest), dtype=np.uint64)]).view(np.int64), doc[order], at[order]]
    arrays, names = [pa.array(c) for c in columns], ["name", "second", "doc", "at"]
    if around is not None:
        width = around.shape[1]
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(order), [None, pa.py_buffer(np.ascontiguousarray(around[order]).tobytes())])
        arrays, names = [*arrays, fixed.cast(pa.binary())], [*names, "around"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def name_rows(batches: Iterator[pa.RecordBatch], of_row) -> Iterator[pa.RecordBatch]:
    """``of_row`` yields (name, second, at[, around]) arrays of one input row (as a dict); rows leave in chunks."""
    parts, held = [], 0
    for batch in text_slices(batches, 200):
        for row in batch.to_pylist():
            for name, second, at, *around in of_row(row):
                parts.append((name, second, np.full(len(name), row["doc"], dtype=np.int64), at.astype(np.int64), *around))
                held += len(name)
            if held >= FLUSH:
                yield batch_of(*(np.concatenate(p) for p in zip(*parts)))
                parts, held = [], 0
    if held:
        yield batch_of(*(np.concatenate(p) for p in zip(*parts)))


def name_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the single starts of cells (doc, at, name, around)."""
    for batch in text_slices(batches, FLUSH // CELL):
        doc, at, name = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "at", "name"))
        around = np.frombuffer(b"".join(batch.column("around").to_pylist()), dtype=np.uint8).reshape(len(doc), -1)
        found = [np.concatenate(c) for c in zip(*starts(name.view(np.uint64), at, around))]
        if len(doc):
            yield batch_of(found[0], found[1], doc[found[3]], found[2])


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (name, second, doc, at): repeats (whole), and the first row of each of several
    ``second`` under one name (not whole). One row is carried from batch to batch."""

    def marked(rows: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
        more = ["around"] if "around" in rows.schema.names else []
        arrays = [*(rows.column(c) for c in ("doc", "at", "name")), pa.array(np.full(rows.num_rows, whole)), *(rows.column(c) for c in more)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc", "at", "name", "whole", *more])

    before: tuple[int, int] | None = None
    pending: pa.RecordBatch | None = None  # the first row of the current name, while it has one ``second``
    for batch in batches:
        yield marked(batch.filter(pc.equal(batch.column("second"), 0)), True)
        rows = batch.filter(pc.not_equal(batch.column("second"), 0))
        if not rows.num_rows:
            continue
        name, second = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("name", "second"))
        new_name = np.concatenate([[before is None or before[0] != name[0]], name[1:] != name[:-1]])
        new = new_name | np.concatenate([[before is None or before[1] != second[0]], second[1:] != second[:-1]])
        yield marked(rows.filter(pa.array(~new)), True)
        firsts = np.flatnonzero(new)
        leads = firsts[:-1][new_name[firsts[:-1]] & ~new_name[firsts[1:]]]
        yield marked(rows.take(pa.array(np.concatenate([leads, firsts[~new_name[firsts]]]))), False)
        if pending is not None and len(firsts) and not new_name[firsts[0]]:
            yield marked(pending, False)
            pending = None
        if new_name.any():
            lead = int(np.flatnonzero(new_name)[-1])
            pending = None if new[lead + 1:].any() else rows.slice(lead, 1)
        before = (int(name[-1]), int(second[-1]))


def _sorted_repeats(rows: DataFrame, extra: str = "") -> DataFrame:
    return rows.repartition("name").sortWithinPartitions("name", "second", "doc", "at").mapInArrow(compare_neighbours, REPEATS + extra)


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, data: binary, doc) and the distinct documents (doc, data).

    ``doc`` is a number in the order of ids: the id itself where no id is null or repeated.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    ids = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        return d.withColumn("doc", F.col("doc_id")), d.select(F.col("doc_id").alias("doc"), "data")
    texts = d.withColumn("digest", F.md5("data"))
    keys = checkpoint(texts.select("doc_id", "digest").distinct().sort("doc_id", "digest").withColumn("doc", F.monotonically_increasing_id()), "keys")
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "doc")
    keyed = checkpoint(texts.join(keys, texts["doc_id"].eqNullSafe(keys["_id"]) & (texts["digest"] == keys["_digest"])).select("doc_id", "data", "doc"), "keyed")
    return keyed, checkpoint(keyed.dropDuplicates(["doc"]).select("doc", "data"), "texts")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null where nothing goes) of every row."""
    if not max(gram, 2 * CELL) < length <= gram + LOW:
        raise ValueError("the gram must be shorter than the string by less than 256 bytes")
    rows, texts = with_keys(docs, id_col, text_col)
    texts = texts.filter(F.octet_length("data") >= length)

    def name_blocks(row: dict):
        yield from blocks(np.frombuffer(row["data"], dtype=np.uint8), length, gram)

    def name_cells(row: dict):
        yield cells(np.frombuffer(row["data"], dtype=np.uint8), np.array(row["places"], dtype=np.int64), length)

    with freed_shuffles(docs.sparkSession):
        coarse = checkpoint(_sorted_repeats(texts.mapInArrow(lambda it: name_rows(it, name_blocks), ROWS)), "blocks")
        places = coarse.filter("NOT whole").groupBy("doc").agg(F.collect_list("at").alias("places"))
        cut_up = texts.join(places, "doc").mapInArrow(lambda it: name_rows(it, name_cells), ROWS + ", around binary")
        fine = checkpoint(_sorted_repeats(cut_up, ", around binary"), "cells")
        single = checkpoint(_sorted_repeats(fine.filter("NOT whole").mapInArrow(name_starts, ROWS)).filter("whole"), "starts")
    gone = coarse.filter("whole").select("doc", "at").union(fine.filter("whole").select("doc", "at")).union(single.select("doc", "at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 200):
            out: list[tuple] = []
            for data, places in zip(batch.column("data").to_pylist(), batch.column("places").to_pylist()):
                at = np.array(places, dtype=np.int64)
                edges = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(edges, at >> 16, 1)
                np.add.at(edges, (at >> 16) + (at & LOW) + length, -1)
                removed = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(data, dtype=np.uint8)[~removed].tobytes()
                out.append((int(removed.sum()), int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum()), kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[] for _ in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc")] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.string()))],
                                             names=["doc", "n_removed", "n_spans", "kept", "sha"])

    per_doc = gone.groupBy("doc").agg(F.collect_list("at").alias("places"))
    cleaned = texts.join(per_doc, "doc").select("doc", "data", "places").mapInArrow(cut, "doc long, n_removed long, n_spans long, kept binary, sha string")
    whole = rows.select("doc_id", "doc", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("whole_sha"))
    return whole.join(cleaned, "doc", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("sha", "whole_sha").alias("kept_sha256"), "kept")
