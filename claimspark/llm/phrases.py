"""Collocations per language: Misra-Gries summaries per hash partition, then exact counts of what survives.

First pass. Each task counts the hashes of all n-grams of a slab of text and hands on one summary per hash
partition. The summaries of a partition are merged in one stream: counters add up, and beyond ``capacity``
counters the smallest are paid off by lowering all of them. What was paid off in all, ``lost``, never reaches
the threshold, so an n-gram that occurs ``min_count`` times keeps a counter. There are so many partitions that a
capacity exceeds the expected mass of a partition divided by the threshold; should a partition still need
more, its capacity grows instead of losing an n-gram. Survivors set one bit each in a filter of at most
``FILTER_BITS`` bits, the only thing that goes to the driver and to all tasks.

Second pass. N-grams whose bit is set, and whose shorter parts have theirs, are counted exactly by their words; equal bits of
other n-grams cost rows, never results. When survivors fill the filter (from some 10**8 on) the pass turns into a full exact count.
Scores use whole numbers of 38 digits.

Null texts have no words; a null language counts as ``und``, together with a real one of that name. Repeated rows count each
time. Ties are ordered by count and phrase. An empty table gives no rows. Other columns are not read. Very long texts are
worked on in parts that overlap by the words an n-gram can reach back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import freed_shuffles, text_slices
from claimspark.llm.shingles import mix
from claimspark.operators.skew import skew_join
from claimspark.session import checkpoint

SLAB_BYTES = 1 << 23  # text that a task counts at once
PART_BYTES = 1 << 22  # longest part of one text
CAPACITY = 1 << 20  # counters of a summary
FILTER_BITS = 1 << 28
HASH_BITS = 40  # of a hash within its partition
BREAK = b"\xff"  # occurs in no UTF-8 text
STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
_TABLE[9] = 32
for _mark in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_mark] = 255
TABLE = bytes(_TABLE)


class Slab:
    """The words of one language: distinct words, their code at every place (0 at breaks), and places that only give context."""

    def __init__(self, tokens: list[bytes], lang: str, skip: int = 0):
        import xxhash

        distinct = set(tokens)
        distinct.discard(BREAK)
        self.words = [BREAK, *distinct]
        index = dict(zip(self.words, range(len(self.words))))
        self.codes = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        self.skip = skip
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def n_words(self) -> int:
        return int(np.count_nonzero(self.codes[self.skip:]))

    def ends(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Those starts of k words that end behind the context."""
        return starts[starts + k > self.skip]


def slabs(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[str, Slab]]:
    """The texts (lang, text) as slabs of one language each."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def tokens(data: bytes) -> list[bytes]:
        return data.translate(TABLE).replace(BREAK, b" \xff ").split()

    def flush() -> Iterator[tuple[str, Slab]]:
        nonlocal size
        for lang, texts in held.items():
            yield lang, Slab(tokens(b"\n".join(texts)), lang)
        held.clear()
        size = 0

    for batch in text_slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8", "replace")
            if len(data) > PART_BYTES:
                at, tail = 0, []
                while at < len(data):
                    cut = data.find(b" ", at + PART_BYTES)
                    end = len(data) if cut < 0 else cut
                    part = tail + tokens(data[at:end])
                    yield lang, Slab(part, lang, len(tail))
                    at, tail = end, part[-(max_words - 1):] if max_words > 1 else []
                continue
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= SLAB_BYTES:
                yield from flush()
    yield from flush()


def deeper(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(hashes * STEP + word)


def occurrences(slab: Slab, max_words: int) -> np.ndarray:
    """The hash of every occurrence of 1 to ``max_words`` words without a break."""
    codes, out = slab.codes, []
    starts = np.flatnonzero(codes)
    hashes = mix(slab.hashes[codes[starts]])
    for k in range(1, max_words + 1):
        if k > 1:
            fits = starts + k - 1 < len(codes)
            starts, hashes = starts[fits], hashes[fits]
            last = codes[starts + k - 1]
            fits = last > 0
            starts = starts[fits]
            hashes = deeper(hashes[fits], slab.hashes[last[fits]])
        out.append(hashes[starts + k > slab.skip])
    return np.concatenate(out)


def planes(values: np.ndarray, n_bytes: int) -> bytes:
    """The low bytes of the values, one byte position after the other, which compresses sorted values well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def unplanes(data: bytes, n_bytes: int) -> np.ndarray:
    wide = np.zeros((len(data) // n_bytes, 8), dtype=np.uint8)
    wide[:, :n_bytes] = np.frombuffer(data, np.uint8).reshape(n_bytes, -1).T
    return wide.view("<u8").ravel()


class MisraGries:
    """A mergeable summary: at most ``capacity`` counters, unless that would cost an item that occurs ``threshold`` times."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.mass, self.lost = capacity, threshold, 0, 0
        self.items, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def merge(self, items: np.ndarray, counts: np.ndarray) -> None:
        """Add the counters of another summary; they are taken in once as many wait as fit."""
        self._waiting.append((items, counts))
        self._size += len(items)
        self.mass += int(counts.sum())
        if self._size >= self.capacity:
            self.settle()

    def settle(self) -> None:
        items = np.concatenate([self.items, *(i for i, _ in self._waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self._waiting)])
        self._waiting, self._size = [], 0
        if not len(items):
            return
        order = np.argsort(items, kind="stable")
        items, counts = items[order], counts[order]
        edges = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        self.items, self.counts = items[edges], np.add.reduceat(counts, edges)
        if len(self.items) > self.capacity:
            pay = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            if self.lost + pay < self.threshold:
                keep = self.counts > pay
                self.items, self.counts, self.lost = self.items[keep], self.counts[keep] - pay, self.lost + pay

    def survivors(self) -> np.ndarray:
        self.settle()
        return self.items[self.counts + self.lost >= self.threshold]


def _power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def survivor_filter(texts: DataFrame, max_words: int, min_count: int, capacity: int = CAPACITY, max_bits: int = FILTER_BITS) -> tuple[np.ndarray, int]:
    """Bits of the n-grams that survive, and the binary logarithm of the number of partitions.

    ``texts``: lang, text. The bits of a partition are one after another, so each reducer makes its own part.
    """
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    mass = max_words * (size // 2 + 1)  # a word takes two bytes at least
    n_parts = max(64, _power_of_two(mass // (capacity * min_count) + 1))
    part_bits = max(64, min(max_bits, _power_of_two(8 * mass // min_count)) // n_parts)
    shift = np.uint64(64 - n_parts.bit_length() + 1)
    low = np.uint64((1 << HASH_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slab in slabs(batches, max_words):
            hashes = occurrences(slab, max_words)
            if not len(hashes):
                continue
            hashes.sort()
            edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            items, counts = hashes[edges], np.diff(np.append(edges, len(hashes)))
            bounds = np.searchsorted(items >> shift, np.arange(n_parts + 1, dtype=np.uint64)).tolist()
            for a in range(0, n_parts, 64):
                rows = [(p, planes(items[lo:hi] & low, 5), planes(counts[lo:hi], 4)) for p, lo, hi in zip(range(a, a + 64), bounds[a:], bounds[a + 1:]) if lo < hi]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["part", "items", "counts"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None

        def out() -> pa.RecordBatch:
            bits = np.zeros(part_bits, dtype=bool)
            bits[summary.survivors() % np.uint64(part_bits)] = True
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for batch in text_slices(batches, 64):
            for p, items, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if summary:
                        yield out()
                    part, summary = p, MisraGries(capacity, min_count)
                summary.merge(unplanes(items, 5), unplanes(counts, 4).astype(np.int64))
        if summary:
            yield out()

    with freed_shuffles(texts.sparkSession):
        found = texts.mapInArrow(count, "part int, items binary, counts binary").repartition("part").sortWithinPartitions("part").mapInArrow(reduce, "part int, bits binary").toArrow()
    out = np.zeros((n_parts, part_bits // 8), dtype=np.uint8)
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.ravel(), n_parts.bit_length() - 1


class Filter:
    def __init__(self, bits: np.ndarray, log_parts: int):
        self.bits, self.shift = bits, np.uint64(64 - log_parts)
        self.part_bits = np.uint64(8 * len(bits) >> log_parts)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift) * self.part_bits + (hashes & np.uint64((1 << HASH_BITS) - 1)) % self.part_bits
        return (self.bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def exact_counts(texts: DataFrame, passes: tuple[np.ndarray, int], max_words: int) -> DataFrame:
    """``lang``, ``phrase``, ``k`` (words), ``f`` of all n-grams whose bit is set; k = 0 has the words of a language."""
    shared = texts.sparkSession.sparkContext.broadcast(passes)

    def batch_of(lang: str, names: list[str], k: int, counts) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(names)), pa.array(names), pa.array(np.full(len(names), k, np.int32)), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "k", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = Filter(*shared.value)
        for lang, slab in slabs(batches, max_words):
            codes, n = slab.codes, len(slab.words)
            yield batch_of(lang, [""], 0, [slab.n_words()])
            hashes = mix(slab.hashes)
            good = passing(hashes)
            good[0] = False
            starts = np.flatnonzero(good[codes])
            names, which, hashes = slab.words, codes[starts], hashes[codes[starts]]
            for k in range(1, max_words + 1):
                if k > 1:
                    # Both parts that lack one word at an end must have their bit, as well as the whole.
                    fits = np.flatnonzero(starts[1:] == starts[:-1] + 1) if k > 2 else np.flatnonzero(starts + 1 < len(codes))
                    fits = fits[good[codes[starts[fits] + k - 1]]]
                    last = codes[starts[fits] + k - 1]
                    deep = deeper(hashes[fits], slab.hashes[last])
                    bit = passing(deep)
                    fits, last, hashes = fits[bit], last[bit], deep[bit]
                    starts = starts[fits]
                    keys, which = np.unique(which[fits] * n + last, return_inverse=True)
                    names = [names[a] + b" " + slab.words[b] for a, b in zip((keys // n).tolist(), (keys % n).tolist())]
                counts = np.bincount(which[starts + k > slab.skip], minlength=len(names))
                used = np.flatnonzero(counts)
                for at in range(0, len(used), 20_000):
                    some = used[at:at + 20_000]
                    yield batch_of(lang, [names[i].decode("utf-8", "replace") for i in some.tolist()], k, counts[some])

    return texts.mapInArrow(run, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, top: int = 2000, swallow_percent: int = 50, capacity: int = CAPACITY,
                 max_bits: int = FILTER_BITS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases.

    ``docs``: lang, text. A phrase of 2 to ``max_words`` words with count a is cut after each word; the cut with the lowest
    a * a / (l * r), l and r the counts of its parts, gives the score in millionths. Phrases within a longer
    candidate that makes up ``swallow_percent`` of their count are dropped. Counts up to 10**15 stay exact.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with freed_shuffles(docs.sparkSession):
        passes = survivor_filter(texts, max_words, min_count, capacity, max_bits)
        counts = checkpoint(exact_counts(texts, passes, max_words).filter((F.col("k") == 0) | (F.col("f") >= min_count)), "phrase-counts")
    sizes = counts.filter("k = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    candidates = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "), "right": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    parts = counts.filter(f"k > 0 AND k < {max_words}")
    cuts = skew_join(cuts, parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = skew_join(cuts, parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    scored = cuts.withColumns({"_up": (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), "_down": whole("l") * whole("r")})
    scored = scored.withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_cut"))
    inner = []
    for k in range(2, max_words):  # every run of k words of a longer candidate
        longer = candidates.filter(F.col("k") > k).withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("k") - k + 1)))
        inner.append(longer.select("lang", F.array_join(F.slice(words, F.col("_at"), F.lit(k)), " ").alias("phrase"), "a"))
    if inner:
        around = inner[0]
        for more in inner[1:]:
            around = around.union(more)
        around = around.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
        best = best.join(around, ["lang", "phrase"], "left").filter(f"_longer IS NULL OR 100 * _longer < {swallow_percent} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = best.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
