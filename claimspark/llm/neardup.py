"""Near-duplicate documents by a MinHash LSH forest, with every link confirmed on the full shingle sets.

A document is the set of its distinct k-word shingles (words lower-cased A-Z; fewer words: the whole sequence
as one; no words: empty). Two documents are linked if 100 * intersection >= percent * union. Equal sets are
collapsed first, so copies cost one row however many there are.

Forest: each of ``TREES`` trees orders the documents by its own sequence of minima. A region is a group
that shares a prefix; its depth adapts, as a prefix with more than ``MAX_REGION`` documents is split by a longer one.
1. In the first trees, neighbours in the order, which share the longest prefixes, are candidates: a
   linear number of pairs, confirmed and contracted to components.
2. In all trees, the members of a region that are still in different components are compared by their whole
   signatures. Of the pairs that seem linked only those that join two components within the region, best first, are
   confirmed and contracted: fewer pairs than members.
3. The same comparison again, now of every pair in different components that could reach the bound. Each pair is met
   in one tree only, the first in which both have the same final region, and a family of thousands of copies has no
   pairs left within a component.
A region that stays too large at the greatest depth is cut into blocks. In passes 1 and 2, which only save work, each block
contains the same hub; in pass 3 every block meets every other, but for those of the region's largest component
among themselves, so every pair of the region is met and no task holds more than two blocks.

A pair at the bound shares a region of the least depth in some tree with probability 1 - 5e-11 (32 trees, 4 minima,
similarity 0.85), and 1 - 3e-7 where all regions have the greatest depth; the estimate from ``SIGNATURE`` minima stays above its cut with 1 - 1e-6. Shingles are compared
by 64-bit hashes.

Null and empty texts are linked with nothing. Null ids take no part: component null, kept. Rows are judged by their
text, so rows that repeat an id give one result each. Empty tables give no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import text_slices
from claimspark.llm.components import connected_components
from claimspark.llm.shingles import MinHash, groups, mix, set_digest, shingle_set
from claimspark.session import checkpoint

TREES, DEPTHS = 32, (4, 6)  # at most three depths: a row's depths in all trees are one number of two bits a tree
ORDER_DEPTH = 16  # minima by which pass 1 sorts a region
LEADING = TREES * DEPTHS[0]  # minima kept whole, for the orders; of the others one byte is kept
SIGNATURE = 768
NEIGHBOUR_TREES = 4
MAX_REGION = 3000
SLACK = 5  # standard errors that an estimate may fall below the bound

FEATURES = "doc_id long, n_shingles long, digest binary, minima binary, rest binary"


def features(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Set size, digest and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(SIGNATURE)
        for batch in text_slices(batches, 200):
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digest, minima, rest = ([None] * len(sets) for _ in range(3))
            for i, sig in zip(full, minhash.signatures([sets[i] for i in full])):
                digest[i], minima[i] = set_digest(sets[i]), sig[:LEADING].astype("<u4").tobytes()
                rest[i] = (sig[LEADING:] >> np.uint32(7)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(c, pa.binary()) for c in (digest, minima, rest)]],
                names=["doc_id", "n_shingles", "digest", "minima", "rest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FEATURES)


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``rep``, ``n`` and ``shingles`` (sorted 64-bit hashes) of the documents in ``ids`` (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 200):
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["rep", "digest", "shingles"])

    d = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    # the digest picks the right text where rows repeat an id
    return d.join(ids.select("rep"), "rep", "left_semi").mapInArrow(run, "rep long, digest binary, shingles binary") \
        .join(ids, ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"]).select("rep", "shingles")


def _label(minima: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` minima of each row in the order of its tree."""
    at = (tree[:, None] * DEPTHS[0] + np.arange(depth)[None, :]) % LEADING
    return np.take_along_axis(minima, at, axis=1)


def _keys(labels: np.ndarray, tree: np.ndarray) -> np.ndarray:
    key = mix(tree.astype(np.uint64) + np.uint64(labels.shape[1] << 8))
    for column in range(labels.shape[1]):
        key = mix(key ^ labels[:, column].astype(np.uint64)) * np.uint64(3)
    return key.view(np.int64)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _region_keys(reps: DataFrame, depth: int, trees: bool) -> DataFrame:
    """(rep, tree, region): every tree of each row, or of rows that carry a tree its deeper key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1000):
            rep = batch.column("rep").to_numpy()
            minima = _matrix(batch.column("minima"), "<u4", LEADING)
            if trees:
                tree = batch.column("tree").to_numpy().astype(np.int64)
            else:
                tree = np.tile(np.arange(TREES), len(rep))
                rep, minima = np.repeat(rep, TREES), np.repeat(minima, TREES, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(tree.astype(np.int32)), pa.array(_keys(_label(minima, tree, depth), tree))],
                                             names=["rep", "tree", "region"])

    return reps.mapInArrow(run, "rep long, tree int, region long")


def forest_regions(reps: DataFrame, max_region: int = MAX_REGION) -> tuple[DataFrame, DataFrame]:
    """(rep, tree, level, region, n) of all regions with at least two members, each at the depth its size asks for; and the
    ``levels`` of each rep, two bits a tree: 0 without a region, else one more than the region's level."""
    parts, rows = [], checkpoint(_region_keys(reps.select("rep", "minima"), DEPTHS[0], False), "forest")
    for level, depth in enumerate(DEPTHS):
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = checkpoint(rows.join(sizes, "region").select("rep", "tree", F.lit(level).alias("level"), "region", "n"), "regions")
        if depth == DEPTHS[-1]:
            parts.append(sized)
            break
        parts.append(sized.filter(F.col("n") <= max_region))
        large = sized.filter(F.col("n") > max_region)
        if large.isEmpty():
            break
        rows = checkpoint(_region_keys(large.select("rep", "tree").join(reps.select("rep", "minima"), "rep"), DEPTHS[level + 1], True), "forest")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = checkpoint(out, "forest-regions")
    levels = out.groupBy("rep").agg(F.expr("bit_or(shiftleft(cast(level + 1 AS bigint), 2 * tree))").alias("levels"))
    return out, checkpoint(levels, "levels")


def hub_blocks(regions: DataFrame, max_region: int) -> DataFrame:
    """The regions with those over ``max_region`` cut into blocks that share one member."""
    large = regions.filter(F.col("n") > max_region)
    hubs = large.groupBy("region").agg(F.min("rep").alias("hub"))
    blocks = F.ceil(F.col("n") / max_region).cast("int")
    block = F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int")))
    cut = large.join(hubs, "region").withColumn("block", F.explode(block)).withColumn("region", F.xxhash64("region", "block")).drop("block", "hub")
    return regions.filter(F.col("n") <= max_region).unionByName(cut)


def met_blocks(placed: DataFrame, max_region: int) -> DataFrame:
    """``placed`` rows (with component) and ``block``; regions over ``max_region`` as one group for each two blocks of which not both
    lie in the region's largest component. Within a group only rows of different ``block`` are to be compared."""
    large = placed.filter(F.col("n") > max_region)
    counts = large.groupBy("region", "component").agg(F.count(F.lit(1)).alias("size"))
    half = max(1, max_region // 2)
    blocks = lambda size: F.ceil(size / half).cast("int")
    plan = counts.groupBy("region").agg(F.max(F.struct("size", "component")).alias("top")) \
        .select("region", F.col("top.component").alias("largest"), F.col("top.size").alias("inside"))
    d = large.join(plan, "region").withColumn("a", blocks(F.col("n") - F.col("inside"))).withColumn("b", blocks(F.col("inside")))
    inner = F.col("component") == F.col("largest")
    d = d.filter("a > 0").withColumn("own", F.when(inner, F.col("a") + F.pmod(F.xxhash64("rep"), F.col("b"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("a"))).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("a")).otherwise(F.col("a") + F.col("b")) - 1)))
    cut = d.select("rep", "tree", "component", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"),
                   F.when(F.col("own") == F.col("other"), F.col("rep")).otherwise(F.col("own").cast("long")).alias("block"))
    return placed.filter(F.col("n") <= max_region).select("rep", "tree", "component", "region", F.col("rep").alias("block")).unionByName(cut)


def _by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole regions of a stream sorted by region."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        region = batch.column("region").to_numpy()
        last = int(np.searchsorted(region, region[-1]))
        if last or (held and held[-1].column("region")[-1].as_py() != region[0]):
            if held and not last:  # the held rows end before this batch
                yield pa.Table.from_batches(held)
                held = []
            elif last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def neighbour_pairs(regions: DataFrame, reps: DataFrame, bound: float) -> DataFrame:
    """Distinct pairs of neighbours in the orders of the first trees whose estimate can reach the bound."""
    cut = bound - SLACK * (bound * (1 - bound) / LEADING) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_region(batches):
            rep, region = table.column("rep").to_numpy(), table.column("region").to_numpy()
            tree = table.column("tree").to_numpy().astype(np.int64)
            minima = _matrix(table.column("minima"), "<u4", LEADING)
            label = _label(minima, tree, ORDER_DEPTH)
            order = np.lexsort((rep, *label.T[::-1], region))
            a, b = order[:-1], order[1:]
            good = (region[a] == region[b]) & (rep[a] != rep[b])
            a, b = a[good], b[good]
            near = (minima[a] == minima[b]).mean(axis=1) >= cut
            x, y = rep[a[near]], rep[b[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = regions.filter(F.col("tree") < NEIGHBOUR_TREES).join(reps.select("rep", "minima"), "rep")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long").distinct()


def spanning(x: np.ndarray, y: np.ndarray, same: np.ndarray, component: dict[int, int]) -> np.ndarray:
    """Which pairs, taken from the most similar on, join two components."""
    root = {c: c for c in component.values()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    joins = np.zeros(len(x), dtype=bool)
    for at in np.argsort(-same, kind="stable").tolist():
        p, q = find(component[int(x[at])]), find(component[int(y[at])])
        if p != q:
            root[p], joins[at] = q, True
    return joins


def common_trees(equal: np.ndarray, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In which trees rows have the same final region, from equality of minima and the ``levels`` of one row and of the others."""
    shift = 2 * np.arange(TREES, dtype=np.uint64)
    own, other = (mine.view(np.uint64) >> shift) & np.uint64(3), (others.view(np.uint64)[:, None] >> shift) & np.uint64(3)
    common = np.zeros((len(equal), TREES), dtype=bool)
    for level, depth in enumerate(DEPTHS):
        trees = np.flatnonzero(own == level + 1)
        if len(trees):
            at = (trees[:, None] * DEPTHS[0] + np.arange(depth)[None, :]) % LEADING
            common[:, trees] = (other[:, trees] == level + 1) & equal[:, at].all(axis=2)
    return common


def region_pairs(members: DataFrame, reps: DataFrame, levels: DataFrame, bound: float, forest: bool) -> DataFrame:
    """Pairs of one region in different components and blocks that can reach the bound, each from its first common tree.

    With ``forest`` those whose estimate reaches it, and of them only as many as join components.
    """
    cut = bound if forest else bound - SLACK * (bound * (1 - bound) / SIGNATURE) ** 0.5
    first_cut = bound - SLACK * 1.3 * (bound * (1 - bound) / LEADING) ** 0.5

    def pairs(rep, component, block, levels, tree, minima, rest) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        values, sizes = np.unique(component, return_counts=True)
        largest = values[np.argmax(sizes)]
        order = np.argsort(component == largest, kind="stable")  # the largest component last
        rep, component, block, levels, minima, rest = (c[order] for c in (rep, component, block, levels, minima, rest))
        for i in range(int((component != largest).sum())):
            j = i + 1 + np.flatnonzero((component[i + 1:] != component[i]) & (block[i + 1:] != block[i]))
            j = j[(minima[j] == minima[i]).mean(axis=1) >= first_cut]
            if not len(j):
                continue
            same = (minima[j] == minima[i]).sum(axis=1) + (rest[j] == rest[i]).sum(axis=1)
            j, same = j[same >= cut * SIGNATURE], same[same >= cut * SIGNATURE]
            mine = common_trees(minima[j] == minima[i], levels[i:i + 1], levels[j]).argmax(axis=1) == tree
            if mine.any():
                yield np.full(int(mine.sum()), rep[i]), rep[j[mine]], same[mine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_region(batches):
            region = table.column("region").to_numpy()
            rep, component, block, levels, tree = (table.column(c).to_numpy() for c in ("rep", "component", "block", "levels", "tree"))
            minima = _matrix(table.column("minima"), "<u4", LEADING)
            rest = _matrix(table.column("rest"), "u1", SIGNATURE - LEADING)
            for start, end in groups(region):
                part = slice(start, end)
                found = list(pairs(rep[part], component[part], block[part], levels[part], int(tree[start]), minima[part], rest[part]))
                if found:
                    x, y, same = (np.concatenate(column) for column in zip(*found))
                    if forest:
                        joins = spanning(x, y, same, dict(zip(rep[part].tolist(), component[part].tolist())))
                        x, y = x[joins], y[joins]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = members.join(reps.select("rep", "minima", "rest"), "rep").join(levels, "rep")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(reps.select("rep", "digest"), "rep")
    sets = checkpoint(shingle_sets(docs, ids, k, id_col, text_col), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 500):
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    rows = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a") \
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, max_region: int = MAX_REGION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    bound = percent / 100
    rows = checkpoint(features(docs, k, id_col, text_col), "features")
    full = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = checkpoint(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("minima").alias("minima"), F.first("rest").alias("rest")), "reps")
    regions, levels = forest_regions(reps, max_region)
    blocked = hub_blocks(regions, max_region)

    first = checkpoint(neighbour_pairs(blocked, reps, bound), "neighbours")
    links = checkpoint(confirmed(first, docs, reps, percent, k, id_col, text_col), "links")
    parts = connected_components(links)

    for forest in (True, False):
        placed = (blocked if forest else regions).join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = placed.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("region")
        placed = placed.join(mixed, "region", "left_semi")
        members = placed.withColumn("block", F.col("rep")) if forest else met_blocks(placed, max_region)
        pairs = checkpoint(region_pairs(members, reps, levels, bound, forest), "region-pairs")
        links = links.unionByName(checkpoint(confirmed(pairs, docs, reps, percent, k, id_col, text_col), "links"))
        parts = connected_components(links)

    rep_of = reps.select("digest", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(rep_of, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
