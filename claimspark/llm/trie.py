"""Prefix tree of conversations as a z-fast trie: compacted nodes, hashed at the two-fattest depth of their edge.

A conversation is a string of turns. The hash of a prefix is the exclusive or of the 128-bit digests of (depth, role,
text), so it can be built in parts; depth and hash together stand for the prefix. Equal conversations become one string.

* ``nodes``: one row per compacted node (a branching, or the end of a conversation) with the depth and hash of its
  extent, those of its parent, the first step below the parent, and its handle: the prefix of the two-fattest depth in
  (parent's depth, own depth], the one with most zero bits at its end.
* ``exits``: where strings leave the tree, by fat binary search: in each round every string asks for the handle at the
  two-fattest depth of what is left of its interval, a join on depth and hash. Rounds grow with the logarithm of the longest conversation.
* ``insert``: a batch of strings. Only what lies below the deepest matched node is unfolded, with the edges that strings
  leave on their way; prefixes with two next steps, or where something ends, become nodes.
* Sums over subtrees go up by pointer doubling over compacted nodes, in rounds logarithmic in their depth.
* ``expand``: the nodes of every depth along each edge.

Strings are inserted in batches, each several times as large as all before it. A conversation may hold any share of the rows: turns
are numbered across range partitions and prefix hashes are kept in blocks of ``BLOCK`` depths. Ids that end in one place are
hashed in order, from packed chunks.

Null role or text is empty; turns go by number, nulls first, then role and text; repeated rows are turns of their own. Rows
without a conversation id belong to none and are left out. An empty table gives no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import freed_shuffles
from claimspark.operators.skew import skew_join
from claimspark.session import bounded, checkpoint

BLOCK = 256
BATCH_SHARES = (1 / 64, 1 / 8)  # of the strings in the tree after each batch but the last
HEAD_TURNS = 3
CHUNK_IDS = 4096
WORDS = r"[^\x20\x09-\x0D]+"
MAX_ROUNDS = 64


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def digest(*parts: Column) -> tuple[Column, Column]:
    """Two longs of the MD5 of the parts; lengths in front keep them apart."""
    joined = F.md5(F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))).cast("binary"))
    half = lambda at: F.conv(F.substring(joined, at, 16), 16, -10).cast("long")
    return half(1), half(17)


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1 within ``key`` by ``order``, however many rows a key has.

    Rows are dealt by ranges of (key, order), numbered within each range, and moved on by what earlier ranges hold of the key.
    """
    place = F.monotonically_increasing_id()
    dealt = rows.withColumn("_place", place)
    dealt = dealt.repartitionByRange(F.col(key), *order, F.col("_place")).withColumn("_part", F.spark_partition_id())
    dealt = checkpoint(dealt.drop("_place"), "dealt")
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    ahead = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).filter("_before > 0").drop("_n")
    local = dealt.withColumn("_local", F.row_number().over(inside))
    moved = local.join(offsets, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    return moved.withColumn("rank", F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_local", "_before", "_key", "_at")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, depth, role, text, part) after the rebuilding, and all conversation ids."""
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                                               F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranked = checkpoint(numbered(turns, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]), "turns")
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD_TURNS + 1)).cast("int")
    ids = checkpoint(ranked.select("conv").distinct().withColumns({"h": head, "base": F.col("conv") - F.col("conv") % 20}), "ids")
    first = ranked.filter(F.col("rank") <= HEAD_TURNS).select(F.col("conv").alias("base"), F.col("rank").alias("depth"), "role", "text")
    borrowed = ids.join(first, "base").filter("depth <= h").select("conv", "depth", "role", "text", F.lit(-1).alias("_part"))
    have = ids.join(first.groupBy("base").agg(F.max("depth").alias("have")), "base", "left").select(F.col("conv").alias("_conv"), F.least("h", F.coalesce("have", F.lit(0))).alias("shift"), "h")
    own = skew_join(ranked.withColumnRenamed("conv", "_conv"), have, ["_conv"]).filter("rank > h")
    own = own.select(F.col("_conv").alias("conv"), (F.col("rank") - F.col("h") + F.col("shift")).alias("depth"), "role", "text", "_part")
    return borrowed.select("conv", F.col("depth").cast("long").alias("depth"), "role", "text", "_part").unionByName(own), ids.select("conv")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv``, ``depth``, hash (``hi``, ``lo``) and words (``w``) of every prefix; parts of a long conversation are put together by their sums."""
    hi, lo = digest(F.col("depth").cast("string"), F.col("role"), F.col("text"))
    steps = turns.select("conv", "depth", "_part", hi.alias("hi"), lo.alias("lo"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("t"))
    steps = checkpoint(steps, "steps")
    up_to = Window.partitionBy("conv", "_part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = steps.withColumns({"hi": F.bit_xor("hi").over(up_to), "lo": F.bit_xor("lo").over(up_to), "w": F.sum("t").over(up_to)})
    ahead = Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.groupBy(F.col("conv").alias("_conv"), F.col("_part").alias("_at")).agg(F.bit_xor("hi").alias("bh"), F.bit_xor("lo").alias("bl"), F.sum("t").alias("bw"))
    before = before.withColumns({"bh": F.bit_xor("bh").over(ahead), "bl": F.bit_xor("bl").over(ahead), "bw": F.sum("bw").over(ahead)}).filter("bw IS NOT NULL")
    joined = local.join(before, (F.col("conv") == F.col("_conv")) & (F.col("_part") == F.col("_at")), "left")
    zero = F.lit(0)
    return joined.select("conv", "depth", "t", F.col("hi").bitwiseXOR(F.coalesce("bh", zero)).alias("hi"), F.col("lo").bitwiseXOR(F.coalesce("bl", zero)).alias("lo"),
                         (F.col("w") + F.coalesce("bw", zero)).alias("w"))


def blocks_of(paths: DataFrame) -> DataFrame:
    """``x``, ``block``, ``steps``: the prefixes of a string in rows of ``BLOCK`` depths, in order, and the first of the next row."""
    own = F.floor((F.col("depth") - 1) / BLOCK).cast("int")
    both = F.when((F.col("depth") > 1) & ((F.col("depth") - 1) % BLOCK == 0), F.array(own, own - 1)).otherwise(F.array(own))
    steps = F.sort_array(F.collect_list(F.struct("depth", "hi", "lo", "w", "t")))
    return paths.withColumn("block", F.explode(both)).groupBy(F.col("conv").alias("x"), "block").agg(steps.alias("steps"))


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str, small: int) -> DataFrame:
    """A join with a table of unique keys: broadcast if it has at most ``small`` rows, else with hot keys of ``rows`` dealt out."""
    return rows.join(F.broadcast(table), keys, how) if bounded(table, small) else skew_join(rows, table, keys, how)


class ZFastTrie:
    """The tree over strings ``x`` whose prefix hashes lie in ``blocks``; ``nodes`` always holds the root.

    A node: extent (e, hi, lo), parent's extent (p, phi, plo), first step below the parent (first_hi, first_lo), handle
    (f, fhi, flo), a string ``x`` through it, words up to parent and extent (pw, ew).
    """

    NODES = "e long, hi long, lo long, p long, phi long, plo long, first_hi long, first_lo long, f long, fhi long, flo long, x long, pw long, ew long"

    def __init__(self, blocks: DataFrame, longest: int, small: int = 200_000):
        self.blocks, self.longest, self.small, self.spark = blocks, longest, small, blocks.sparkSession
        self.nodes = self.spark.createDataFrame([(0, 0, 0, -1, None, None, None, None, None, None, None, None, 0, 0)], self.NODES)

    def at_depth(self, rows: DataFrame, depth: str, **names: str) -> DataFrame:
        """``rows`` (x, ...) with fields of the prefix of ``x`` at the depth in a column: hi = 0 and so on at depth 0, nulls beyond the end."""
        at = F.col(depth)
        block = self.blocks.select(F.col("x").alias("_x"), F.col("block").alias("_b"), "steps")
        joined = rows.join(block, (F.col("x") == F.col("_x")) & (F.floor((at - 1) / BLOCK).cast("int") == F.col("_b")), "left")
        step = F.get(F.col("steps"), ((at - 1) % BLOCK).cast("int"))
        root = lambda c: F.when(at == 0, F.lit(0).cast("long")).otherwise(c)
        return joined.withColumns({new: root(step[field]) for new, field in names.items()}).drop("_x", "_b", "steps")

    def exits(self, strings: DataFrame) -> DataFrame:
        """``x``, ``n`` with the deepest node whose handle lies on the string: extent (e, ghi, glo) and its parent's depth gp.

        Fat binary search over (a, b]: a found handle raises a to its node's depth, a missing one lowers b below it.
        """
        zero = F.lit(0).cast("long")
        state = strings.select("x", "n", zero.alias("a"), F.col("n").alias("b"), zero.alias("e"), zero.alias("ghi"), zero.alias("glo"), F.lit(-1).cast("long").alias("gp"))
        handles = self.nodes.filter("f IS NOT NULL").select(F.col("f").alias("q"), F.col("fhi").alias("qhi"), F.col("flo").alias("qlo"), F.col("e").alias("_e"),
                                                            F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("p").alias("_p"))
        if handles.isEmpty():
            return state.select("x", "n", "e", "ghi", "glo", "gp")
        for done in range(1, int(self.longest).bit_length() + 2):
            state = state.withColumn("q", F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.col("b"))))
            found = look_up(self.at_depth(state, "q", qhi="hi", qlo="lo"), handles, ["q", "qhi", "qlo"], "left", self.small)
            hit = F.col("_e").isNotNull()
            state = found.select("x", "n", F.when(hit, F.col("_e")).otherwise(F.col("a")).alias("a"),
                                 F.when(F.col("q").isNotNull() & ~hit, F.col("q") - 1).otherwise(F.col("b")).alias("b"),
                                 *(F.coalesce(new, old).alias(old) for new, old in (("_e", "e"), ("_hi", "ghi"), ("_lo", "glo"), ("_p", "gp"))))
            if done % 3 == 0:
                state = checkpoint(state, "search")
        return state.select("x", "n", "e", "ghi", "glo", "gp")

    def unfolded(self, paths: DataFrame) -> DataFrame:
        """One row per depth in (s, n] of every path (x, s, n, ...), with the prefix as ``step`` and the next one as ``next``."""
        blocks = self.blocks.select(F.col("x").alias("_x"), "block", "steps")
        met = paths.join(blocks, (F.col("x") == F.col("_x")) & (F.col("block") * BLOCK < F.col("n")) & ((F.col("block") + 1) * BLOCK > F.col("s")))
        pairs = F.transform(F.slice("steps", 1, BLOCK), lambda v, i: F.struct(v.alias("step"), F.get("steps", i + 1).alias("next")))
        return met.withColumn("_pair", F.explode(pairs)).select(*paths.columns, "_pair.step", "_pair.next").filter("step.depth > s AND step.depth <= n")

    def insert(self, strings: DataFrame) -> None:
        """Add ``strings`` (x, n)."""
        exits = self.at_depth(self.exits(strings), "e", mhi="hi", mlo="lo")
        matched = F.col("mhi").eqNullSafe(F.col("ghi")) & F.col("mlo").eqNullSafe(F.col("glo"))
        exits = exits.withColumn("s", F.when(matched, F.col("e")).otherwise(F.col("gp"))).filter("s < n").withColumn("s1", F.col("s") + 1)
        exits = checkpoint(self.at_depth(exits.select("x", "n", "s", "s1"), "s1", first_hi="hi", first_lo="lo"), "exits")
        # The edge that a string enters below its deepest whole node is unfolded with it, wherever the string leaves it.
        steps = exits.select("s1", "first_hi", "first_lo").distinct()
        edges = checkpoint(self.nodes.withColumn("s1", F.col("p") + 1).join(steps, ["s1", "first_hi", "first_lo"], "left_semi").select("x", F.col("p").alias("s"), "e", "hi", "lo"), "edges")
        rows = self.unfolded(exits.select("x", "s", "n").union(edges.select("x", "s", "e")).distinct())
        later = F.when(F.col("step.depth") < F.col("n"), F.struct("next.hi", "next.lo"))
        met = rows.groupBy(F.col("step.depth").alias("e"), F.col("step.hi").alias("hi"), F.col("step.lo").alias("lo")).agg(
            F.min("x").alias("x"), F.min("s").alias("s"), F.min("step.w").alias("ew"), F.max(F.col("step.depth") == F.col("n")).alias("ends"), F.min(later).alias("least"), F.max(later).alias("most"))
        met = checkpoint(met, "prefixes")
        # A prefix belongs to its smallest string; each string has a run of depths of its own, below a branching of another's.
        own = met.groupBy("x", "s").agg(F.min("e").alias("top"))
        nodes = met.filter("ends OR least <> most").join(own, ["x", "s"])
        above = F.lag("e").over(Window.partitionBy("x", "s").orderBy("e"))
        nodes = nodes.withColumn("p", F.coalesce(above, F.col("top") - 1)).select("e", "hi", "lo", "x", "ew", "p")
        nodes = nodes.withColumns({"f": two_fattest(F.col("p"), F.col("e")), "p1": F.col("p") + 1})
        nodes = self.at_depth(nodes, "p", phi="hi", plo="lo", pw="w")
        nodes = self.at_depth(nodes, "p1", first_hi="hi", first_lo="lo")
        nodes = self.at_depth(nodes, "f", fhi="hi", flo="lo").select(*self.nodes.columns)
        kept = self.nodes.join(edges.select("e", "hi", "lo"), ["e", "hi", "lo"], "left_anti").select(*self.nodes.columns)
        self.nodes = checkpoint(kept.unionByName(nodes), "nodes")

    def summed(self, strings: DataFrame) -> DataFrame:
        """Nodes with sums over their subtrees: ``n`` conversations, ``leaves``, ``cw`` words of all conversations, ``edge`` words of all
        edges, the smallest ``conv``; and ``kids``. By pointer doubling: after round k a node has the sums of all less than 2**k below it."""
        name = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
        ends = strings.select(F.col("n").alias("e"), "hi", "lo", F.col("x").alias("conv"), F.col("count").alias("n"))
        kids = self.nodes.filter("p >= 0").groupBy(F.col("p").alias("e"), F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("kids"))
        zero = F.lit(0).cast("long")
        nodes = self.nodes.join(ends, ["e", "hi", "lo"], "left").join(kids, ["e", "hi", "lo"], "left")
        nodes = nodes.withColumns({"n": F.coalesce("n", zero), "kids": F.coalesce("kids", zero)})
        nodes = nodes.withColumns({"id": name("e", "hi", "lo"), "parent": F.when(F.col("p") >= 0, name("p", "phi", "plo")), "leaves": (F.col("kids") == 0).cast("long"),
                                   "cw": F.col("n") * F.col("ew"), "edge": F.col("ew") - F.col("pw")})
        nodes = checkpoint(nodes, "summed")
        state = nodes.select("id", F.col("parent").alias("up"), "n", "leaves", "cw", "edge", "conv")
        for _ in range(MAX_ROUNDS):
            if state.filter("up IS NOT NULL").isEmpty():
                break
            below = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(*(F.sum(c).alias(f"_{c}") for c in ("n", "leaves", "cw", "edge")), F.min("conv").alias("_conv"))
            higher = look_up(state.withColumnRenamed("id", "_id").withColumnRenamed("up", "id"), state.filter("up IS NOT NULL").select("id", F.col("up").alias("_up")), ["id"], "left", self.small)
            moved = higher.drop("id").withColumnRenamed("_id", "id").withColumnRenamed("_up", "up").join(below, "id", "left")
            state = checkpoint(moved.select("id", "up", *((F.col(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in ("n", "leaves", "cw", "edge")), F.least("conv", "_conv").alias("conv")), "doubled")
        else:
            raise RuntimeError("the tree is too deep")
        return nodes.drop("n", "leaves", "cw", "edge", "conv").join(state.drop("up"), "id")


def ends_hashes(members: DataFrame) -> DataFrame:
    """``end``, ``ends_sha256`` of (end, conv): ids in order, packed in parallel, so the one ordered pass over a hot end reads few rows."""
    ranked = numbered(members, "end", [F.col("conv")])
    packed = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ranked.groupBy("end", F.floor((F.col("rank") - 1) / CHUNK_IDS).alias("at")).agg(packed.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, sha = None, None
        for batch in batches:
            done = []
            for e, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if e == end:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    done.append((end, sha.hexdigest()))
                end, sha = e, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*done) if done else ([], []))], names=["end", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["end", "ends_sha256"])

    return chunks.repartition("end").sortWithinPartitions("end", "at").select("end", "at", "ids").mapInArrow(run, "end string, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, small: int = 200_000) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Tables of at most ``small`` rows are broadcast."""
    with freed_shuffles(conversations.sparkSession):
        turns, ids = rebuilt_turns(conversations)
        paths = checkpoint(prefixes(turns), "paths")
        last = paths.groupBy(F.col("conv").alias("_conv")).agg(F.max("depth").alias("n"), F.max_by(F.struct("hi", "lo", "w"), "depth").alias("at"))
        zero = F.lit(0).cast("long")
        members = ids.join(last, F.col("conv") == F.col("_conv"), "left").select("conv", *(F.coalesce(c, zero).alias(n) for c, n in (("n", "n"), ("at.hi", "hi"), ("at.lo", "lo"), ("at.w", "w"))))
        members = checkpoint(members, "members")
        strings = checkpoint(members.groupBy("n", "hi", "lo").agg(F.min("conv").alias("x"), F.count(F.lit(1)).alias("count")), "strings")
        longest = strings.agg(F.max("n")).first()[0]
        blocks = checkpoint(blocks_of(paths.join(strings.select(F.col("x").alias("conv")), "conv", "left_semi")), "blocks")
        tree = ZFastTrie(blocks, longest or 0, small)
        share, lower = F.pmod(F.xxhash64("x"), F.lit(1 << 20)) / (1 << 20), 0.0
        for upper in (*BATCH_SHARES, 1.0):
            batch = strings.filter((F.col("n") > 0) & (share >= lower) & (share < upper)).select("x", "n")
            lower = upper
            if not batch.isEmpty():
                tree.insert(batch)
        nodes = tree.summed(strings).filter("n > 0")
        up = nodes.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv"))
        nodes = checkpoint(look_up(nodes.withColumn("members", F.col("n")).drop("n"), up, ["parent"], "left", small), "nodes")
        hashes = ends_hashes(members.select(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "hi", "lo"))).alias("end"), "conv"))
        edges = tree.unfolded(nodes.filter("p >= 0").withColumns({"s": F.col("p"), "n": F.col("e")}))
        deep = edges.select("id", "conv", "parent_conv", "members", "kids", "leaves", "cw", "edge", "p", "e", "pw", F.col("step.depth").alias("depth"), (F.col("step.w") - F.col("step.t")).alias("before"))
        root = nodes.filter("p < 0").select("id", "conv", "parent_conv", "members", "kids", "leaves", "cw", "edge", "p", "e", "pw", zero.alias("depth"), zero.alias("before"))
        bottom = F.col("depth") == F.col("e")
        out = root.union(deep).withColumn("end", F.when(bottom, F.col("id")))
        out = out.join(hashes, "end", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("p") + 1, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(bottom, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("cw") - F.col("members") * F.col("before") - F.col("edge") + F.col("before") - F.col("pw")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
