"""Cross-site removal of boilerplate lines.

A line that stands on at least ``min_sites`` different sites is boilerplate: it stays where it occurs first
(smallest document id, then the first such line of that document) and goes everywhere else. Sites are counted
with one HyperLogLog sketch per line hash, which merges by aggregation and combines before the shuffle, so a
line with a third of all rows costs one sketch per task. A sketch can err near the bound only; lines whose
estimate lies within ``band`` of it get an exact distinct count.

Lines are split at \\n and compared whole, by a 128-bit digest; blank lines are never boilerplate. Null
texts stay null and have no lines; a null site counts as one site of its own. Rows that share a document id
(null included) count as one document: each keeps the first occurrence. Texts left without a word stay as
rows. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import WORD
from claimspark.session import checkpoint

MIN_SITES = 10
BAND = 0.15  # more than nine standard errors of a sketch with 2**12 registers
LG_K = 12


def _digests(text: Column) -> Column:
    """The digests of a text's lines in order, null for blank lines."""
    return F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike(WORD), F.md5(line)))


def line_sites(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """Lines (line, doc_id, site) on ``min_sites`` sites or more: the line and its first document."""
    per_line = (lines.groupBy("line")
                .agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc").alias("first"))
                .filter(F.col("n") >= min_sites)
                .select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
                .filter(F.col("sites") >= min_sites * (1 - band)))
    found = checkpoint(per_line, "line-sites")
    near = found.filter(F.col("sites") <= min_sites * (1 + band))
    exact = (lines.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("exact"))
             .filter(F.col("exact") >= min_sites).select("line"))
    return found.filter(F.col("sites") > min_sites * (1 + band)).select("line", "first").unionByName(
        near.join(exact, "line", "left_semi").select("line", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, id_col: str = "doc_id", text_col: str = "text",
                site_col: str = "source", drop_emptied: bool = False) -> DataFrame:
    """The rows of ``docs`` with boilerplate cut out of ``text_col``, and ``_n_lines``, ``_n_removed``.

    With ``drop_emptied`` rows go whose last word went.
    """
    lines = checkpoint(
        docs.select(F.struct(F.col(id_col).alias("id")).alias("doc"), F.coalesce(F.col(site_col).cast("string"), F.lit("\0")).alias("site"),
                    F.explode(F.array_distinct(_digests(F.col(text_col)))).alias("line")).filter("line IS NOT NULL"), "lines")
    common = checkpoint(line_sites(lines, min_sites, band), "boilerplate")
    # per document: the digests to remove, and those of which it keeps the first occurrence
    per_doc = (lines.join(common, "line").groupBy("doc")
               .agg(F.collect_set("line").alias("_common"), F.collect_set(F.when(F.col("doc") == F.col("first"), F.col("line"))).alias("_kept"))
               .select(F.col("doc.id").alias("_id"), "_common", "_kept"))
    # the row travels as one struct, so its columns cannot clash with those of the work
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    d = d.join(per_doc, d["key"].eqNullSafe(per_doc["_id"]), "left")
    d = d.withColumn("lines", F.split("text", "\n")).withColumn("digests", F.when(F.col("_common").isNotNull(), _digests(F.col("text"))))
    stays = lambda line, i: (F.get("digests", i).isNull() | ~F.array_contains("_common", F.get("digests", i))
                             | (F.array_contains("_kept", F.get("digests", i)) & (F.array_position("digests", F.get("digests", i)) == i + 1)))
    d = d.withColumn("left", F.when(F.col("_common").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    text = F.when(F.col("_common").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    count = lambda n: F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long")
    d = d.select("row", F.struct(text.alias("text"), count(F.size("lines")).alias("lines"), count(F.size("lines") - F.size("left")).alias("removed")).alias("out"))
    if drop_emptied:
        # as a generator, since a filter would be pushed below the work on lines and repeat it
        d = d.select("row", F.explode(F.filter(F.array("out"), lambda o: (o["removed"] == 0) | o["text"].rlike(WORD))).alias("out"))
    return d.select(*[F.col("out.text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns],
                    F.col("out.lines").alias("_n_lines"), F.col("out.removed").alias("_n_removed"))
