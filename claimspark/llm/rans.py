"""Token ids in compressed files: static range asymmetric numeral system (rANS) with interleaved lanes.

A store is a folder with three tables. ``table``: one frequency per id, shared by every block, summing to
``1 << SCALE_BITS``. ``blocks``: one row per block of up to ``block_ids`` ids, whose ``data`` is self-contained but
for the table. ``shards``: ids per shard, for the position of a document among all.

Bytes of a block: the header ``HEADER`` (magic, shard, block, ids before it in the shard, ids, documents, lanes, steps between checkpoints,
words, bytes of the directory, ordinal of the first document in its shard, CRC-32 of the ids, CRC-32 of all bytes
behind the header), the directory (zlib over document ids, a flag for null ids and ids per document), the
checkpoints (per checkpoint the word position, then for each the lane states) and the 32-bit words.

Lane i of a block holds ids i, i + lanes, i + 2 * lanes, ... Its state lies in [2**31, 2**63) and gives off or takes up one
32-bit word at most per id, so a step is a handful of array operations over all lanes. The encoder runs from the
last step to the first; every ``check_steps`` steps it notes states and word position, from which a decoder can start.

Documents go in ascending order of id, nulls first, equal ids by the first 64 characters. Null texts are empty and yield the
closing id alone; repeated rows are kept one by one. An empty table yields a store without blocks. Other
columns are not read. A document may span blocks; its checksum is then combined from its pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import freed_shuffles, text_slices
from claimspark.llm.tokenids import text_encoder
from claimspark.session import bounded_broadcast, checkpoint

SCALE_BITS = 20
LANES = 2048
CHECK_STEPS = 128
BLOCK_IDS = 1 << 19
CACHE_WORDS = 450_000  # words of each of the encoder's two generations, together about 200 MB in a Python worker
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
WORD_MASK = np.uint64((1 << 32) - 1)
HEADER = struct.Struct("<4sIIQIIHHIIQII")
MAGIC = b"rAN1"
TOKENS = "shard int, block int, start long, n_ids int, first_ord long, docs binary, ids binary"
BLOCKS = "shard int, block int, start long, n_ids int, data binary"
PIECES = "shard int, ordinal long, start long, doc_id long, length long, crc long"


def shared_frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to ``1 << bits``, at least one for every id that occurs.

    Rounded down from the exact share; what is missing goes to the most frequent ids, what is too much comes from them.
    """
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), dtype=np.int64)
    if len(used) > 1 << bits:
        raise ValueError("more ids in use than the scale has slots")
    total = int(counts.sum())
    out = np.zeros(len(counts), dtype=np.int64)
    out[used] = [max(1, (int(c) << bits) // total) for c in counts[used]]
    order = used[np.lexsort((used, -counts[used]))]
    rest = (1 << bits) - int(out.sum())
    if rest > 0:
        out[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        give = min(int(out[i]) - 1, -rest)
        out[i] -= give
        rest += give
    return out


class Table:
    """Frequencies, their starts, and the id of every slot."""

    def __init__(self, freqs: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.freq = np.uint64(bits), freqs.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.slots = np.repeat(np.arange(len(freqs), dtype=np.int64), freqs.astype(np.int64))


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, check_steps: int = CHECK_STEPS) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Word positions and lane states of the checkpoints, in the order of decoding, and the words."""
    steps = -(-len(ids) // lanes)
    freqs, starts, limits = table.freq[ids], table.start[ids], table.limit[ids]
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    states, written, marks = [], 0, []
    for step in range(steps - 1, -1, -1):
        at = step * lanes
        f, lim = freqs[at:at + lanes], limits[at:at + lanes]
        now = x[:len(f)]
        full = np.flatnonzero(now >= lim)
        if len(full):
            out = now.take(full)
            words.append((out & WORD_MASK).astype("<u4"))
            written += len(out)
            now[full] = out >> WORD_BITS
        high = now // f
        now += (high << table.bits) - high * f + starts[at:at + lanes]
        if step % check_steps == 0:
            states.append(x.copy())
            marks.append(written)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype="<u4")
    return [written - m for m in marks[::-1]], np.array(states[::-1], dtype="<u8").reshape(-1, lanes), stream


def decode(n_ids: int, table: Table, marks: np.ndarray, states: np.ndarray, words: np.ndarray, lanes: int, check_steps: int,
           first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` up to ``last``, decoded from the checkpoint at or before the first."""
    last = n_ids if last is None else min(last, n_ids)
    if first >= last:
        return np.zeros(0, dtype="<u4")
    at_mark = first // (lanes * check_steps)
    step, x, pos = at_mark * check_steps, states[at_mark].astype(np.uint64), int(marks[at_mark])
    begin = step * lanes
    out = np.empty(last - begin, dtype="<u4")
    mask = np.uint64((1 << int(table.bits)) - 1)
    for at in range(begin, last, lanes):
        live = min(lanes, n_ids - at)
        now = x[:live]
        slot = now & mask
        ids = table.slots.take(slot.view(np.int64))
        out[at - begin:at - begin + lanes] = ids[:last - at]
        now >>= table.bits
        now *= table.freq.take(ids)
        now += slot
        now -= table.start.take(ids)
        low = np.flatnonzero(now < LOW)
        if len(low):
            now[low] = (now.take(low) << WORD_BITS) | words[pos:pos + len(low)]
            pos += len(low)
    return out[first - begin:]


def pack_block(shard: int, block: int, start: int, ids: np.ndarray, first_ord: int, docs: bytes, table: Table) -> bytes:
    marks, states, words = encode(ids, table)
    directory = zlib.compress(docs, 1)
    body = directory + np.array(marks, dtype="<u4").tobytes() + states.tobytes() + words.tobytes()
    head = (MAGIC, shard, block, start, len(ids), len(docs) // 13, LANES, CHECK_STEPS, len(words), len(directory), first_ord, zlib.crc32(ids.astype("<u4").tobytes()))
    return HEADER.pack(*head, zlib.crc32(body)) + body


class Block:
    """A block's bytes, taken apart; the bytes are checked against their checksum."""

    def __init__(self, data: bytes):
        magic, self.shard, self.block, self.start, self.n_ids, n_docs, self.lanes, self.check_steps, n_words, n_dir, self.first_ord, self.crc, body_crc = HEADER.unpack_from(data)
        if magic != MAGIC or zlib.crc32(memoryview(data)[HEADER.size:]) != body_crc:
            raise ValueError("damaged block")
        at = HEADER.size
        directory = zlib.decompress(data[at:at + n_dir])
        at += n_dir
        self.doc_ids = np.frombuffer(directory, "<i8", n_docs)
        self.lengths = np.frombuffer(directory, "<u4", n_docs, 8 * n_docs)
        self.nulls = np.frombuffer(directory, "u1", n_docs, 12 * n_docs)
        n_marks = -(-self.n_ids // (self.lanes * self.check_steps))
        self.marks = np.frombuffer(data, "<u4", n_marks, at)
        self.states = np.frombuffer(data, "<u8", n_marks * self.lanes, at + 4 * n_marks).reshape(n_marks, self.lanes)
        self.words = np.frombuffer(data, "<u4", n_words, at + 4 * n_marks + self.states.nbytes)

    def ids(self, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from ``first`` to ``last``; a whole block is checked against the checksum of its ids."""
        out = decode(self.n_ids, table, self.marks, self.states, self.words, self.lanes, self.check_steps, first, last)
        if len(out) == self.n_ids and zlib.crc32(out.tobytes()) != self.crc:
            raise ValueError("damaged ids")
        return out


def crc32_shift(crc: int, n_bytes: int) -> int:
    """The checksum's contribution after ``n_bytes`` more bytes: times x**(8 n) modulo the polynomial, bits reflected."""

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square = 1 << 31, 1 << 23  # x**0 and x**8
    while n_bytes:
        if n_bytes & 1:
            power = times(power, square)
        square = times(square, square)
        n_bytes >>= 1
    return times(power, crc)


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in names.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, block_ids: int) -> DataFrame:
    """Blocks of plain ids, in order of documents; a shard is a range of document ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = text_encoder(tokenizer_path, CACHE_WORDS)
        shard, block, parts, size, ordinal, first_ord, entries = TaskContext.get().partitionId(), 0, [], 0, -1, 0, []

        def close() -> pa.RecordBatch:
            directory = (np.array([e[0] or 0 for e in entries], "<i8").tobytes() + np.array([e[1] for e in entries], "<u4").tobytes()
                         + np.array([e[0] is None for e in entries], "u1").tobytes())
            return _rows(TOKENS, [(shard, block, block * block_ids, size, first_ord, directory, b"".join(parts))])

        for batch in text_slices(batches):
            for doc_id, data in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist())):
                data += end
                n, at = len(data) // 4, 0
                ordinal += 1
                while at < n:
                    take = min(n - at, block_ids - size)
                    if not entries:
                        first_ord = ordinal
                    parts.append(data[4 * at:4 * (at + take)])
                    entries.append((doc_id, take))
                    at, size = at + take, size + take
                    if size == block_ids:
                        yield close()
                        block, parts, size, entries = block + 1, [], 0, []
        if entries:
            yield close()

    # Copies of one id, even of one whole row, are dealt over several ranges by their place in the input.
    order = F.col("doc_id").asc_nulls_first(), F.col("_head"), F.col("_place")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_head": F.substring("text", 1, 64), "_place": F.monotonically_increasing_id()})
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, TOKENS)


def _counts(tokens: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in text_slices(batches, 1):
            got = np.bincount(np.frombuffer(batch.column(0)[0].as_py(), "<u4"))
            if len(got) > len(counts):
                got, counts = counts, got
            counts[:len(got)] += got
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def load_table(spark: SparkSession, path: str) -> Table:
    """The frequencies of a store; they sum to ``1 << SCALE_BITS``, which bounds the rows read."""
    rows = spark.read.parquet(f"{path}/table").toArrow()
    ids, freqs = np.array(rows.column("id"), dtype=np.int64), np.array(rows.column("freq"), dtype=np.int64)
    dense = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int64)
    dense[ids] = freqs
    return Table(dense)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) into a store at ``path``, a folder that all executors reach.

    Texts are shuffled once, by ranges of ids, and tokenised once; the blocks of plain ids are written between the two
    passes. The frequencies are those of all ids. Memory of a task: one batch of texts and one block. A lost
    executor costs the tasks it ran.
    """
    spark = docs.sparkSession
    with freed_shuffles(spark):
        tokens = checkpoint(_tokenise(docs, tokenizer_path, end_id, block_ids), "token-blocks")
        found = _counts(tokens).toArrow()  # at most one row per id of the vocabulary
        ids = np.array(found.column("id"), dtype=np.int64)
        dense = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int64)
        dense[ids] = np.array(found.column("n"), dtype=np.int64)
        freqs = shared_frequencies(dense)
        used = np.flatnonzero(freqs)
        pairs = list(zip(used.tolist(), freqs[used].tolist()))
        spark.createDataFrame(pairs, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
        shared = spark.sparkContext.broadcast(freqs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = None
            for batch in text_slices(batches, 1):
                table = table or Table(shared.value)
                row = batch.to_pylist()[0]
                data = pack_block(row["shard"], row["block"], row["start"], np.frombuffer(row["ids"], "<u4"), row["first_ord"], row["docs"], table)
                yield _rows(BLOCKS, [(row["shard"], row["block"], row["start"], row["n_ids"], data)])

        tokens.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
        shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
        before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
        shards.select("shard", "n_ids", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{path}/shards")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files of a store alone.

    Blocks are decoded independently of each other. The checksum of a document in several blocks is put together from
    those of its pieces, one small row each.
    """
    table = spark.sparkContext.broadcast(load_table(spark, path).freq.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None
        for batch in text_slices(batches, 1):
            shared = shared or Table(table.value)
            block = Block(batch.column(0)[0].as_py())
            data = memoryview(block.ids(shared).tobytes())
            edges = np.concatenate([[0], np.cumsum(block.lengths.astype(np.int64))])
            crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
            starts = block.start + edges[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(crcs), block.shard), pa.int32()), pa.array(block.first_ord + np.arange(len(crcs)), pa.int64()), pa.array(starts, pa.int64()),
                pa.array(block.doc_ids, pa.int64(), mask=block.nulls.astype(bool)), pa.array(block.lengths.astype(np.int64), pa.int64()),
                pa.array(crcs, pa.int64())], names=[c.split(" ")[0] for c in PIECES.split(", ")])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column("pieces").to_pylist():
                crc = pieces[0]["crc"]
                for piece in pieces[1:]:
                    crc = crc32_shift(crc, 4 * piece["length"]) ^ piece["crc"]
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = spark.read.parquet(f"{path}/blocks").select("data").mapInArrow(run, PIECES)
    whole = pieces.groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("length").alias("n_tokens"),
                                                   F.sort_array(F.collect_list(F.struct("start", "length", "crc"))).alias("pieces"))
    joined = whole.select("shard", "doc_id", "start", "n_tokens", "pieces").mapInArrow(join, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    shards = bounded_broadcast(spark.read.parquet(f"{path}/shards").select(F.col("shard").alias("_shard"), "before"), 100_000)
    return joined.join(shards, F.col("shard") == F.col("_shard")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``at``, ``ids`` (array): the ids at places ``first`` up to ``last`` of a store, in parts of one checkpoint each.

    Only blocks that reach into the range are read, and each is decoded from the checkpoint before it.
    """
    table = spark.sparkContext.broadcast(load_table(spark, path).freq.astype(np.int64))
    shards = bounded_broadcast(spark.read.parquet(f"{path}/shards").select(F.col("shard").alias("_shard"), "before"), 100_000)
    blocks = spark.read.parquet(f"{path}/blocks").join(shards, F.col("shard") == F.col("_shard"))
    blocks = blocks.withColumn("begin", F.col("before") + F.col("start")).filter((F.col("begin") < last) & (F.col("begin") + F.col("n_ids") > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None
        for batch in text_slices(batches, 1):
            shared = shared or Table(table.value)
            begin, block = batch.column(0)[0].as_py(), Block(batch.column(1)[0].as_py())
            step = block.lanes * block.check_steps
            lo, hi = max(0, first - begin), min(block.n_ids, last - begin)
            while lo < hi:
                end = min(hi, (lo // step + 1) * step)
                ids = block.ids(shared, lo, end).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([begin + lo], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["at", "ids"])
                lo = end

    return blocks.select("begin", "data").mapInArrow(run, "at long, ids array<long>")
