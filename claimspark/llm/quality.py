"""Document quality rules: counts of a text, and its divergence from what its language usually looks like.

Everything is a column expression. A document passes if its base counts are sound and the Jensen-Shannon
distance of its character classes and of its common words to the reference of its language stays within
bounds. The references are sums over all documents of the language, so they need one aggregate of a few rows.

Short documents are guarded: below ``min_chars`` the character classes, below ``min_words`` the common words
are not judged, as a histogram of few items is far from any reference by chance.

Null texts have no words and fail the base rule. Null or unlisted languages are compared with the sum over
all documents and the words of the default language. Every row is judged alone, so repeated rows and ids
give equal rows. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import SPACE, WORD
from claimspark.session import checkpoint

# The commonest function words of each language, a parameter of the operator.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not at from this are or an",
    "de": "der die und in den von zu das mit des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur avec",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
}
DEFAULT_LANG = "en"
CHAR_CLASSES = ["lower", "upper", "digit", "punctuation", "symbol", "other"]

MIN_CHARS, MIN_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.28


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _with_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, common: dict[str, list[str]]) -> DataFrame:
    """doc_id, ref, the base counts and both histograms, one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = sorted({w for words in common.values() for w in words})
    # each step is a projection of its own, so what a later step reads several times is computed once
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    d = d.select("doc_id", "lang", _words(text).alias("words"),
                 F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
                 F.regexp_replace(text, r"[a-zß-öø-ÿ\x20\x09-\x0D]+", "").alias("rest"))
    d = d.select("doc_id", "lang", "rest",
                 F.size("words").cast("long").alias("n_words"),
                 F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
                 F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(every)), "  "), F.lit(" ")).alias("commons"))
    windows = F.when(F.col("n_words") >= 5, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")),
        lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("windows", windows).drop("hashes")
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>"))).drop("windows")
    twice = F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]))
    d = d.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("sorted")
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
                          lambda a, s: F.struct((a["n"] + F.least(F.lit(5), s - a["last"])).alias("n"), s.alias("last")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", covered.cast("long")).drop("starts")
    # what is left of the text shrinks from class to class
    for name, pattern in (("upper", r"\p{Lu}+"), ("digit", r"[0-9]+"), ("punctuation", r"""[.,;:!?'"()\-]+"""), ("symbol", r"[#*$%&|<>]+")):
        d = d.withColumn("next", F.regexp_replace("rest", pattern, ""))
        d = d.withColumn(f"c_{name}", (F.length("rest") - F.length("next")).cast("long")).drop("rest").withColumnRenamed("next", "rest")
    d = d.withColumn("c_other", F.length("rest").cast("long"))
    lower = F.col("word_chars") - sum((F.col(f"c_{c}") for c in CHAR_CLASSES[1:]), F.lit(0))
    hit = lambda w: (F.octet_length("commons") - F.octet_length(F.replace("commons", F.lit(f" {w} "), F.lit("")))) / len(f" {w} ".encode())
    by_lang = None
    for lang, words in common.items():
        counts = F.array(*[hit(w).cast("long") for w in words])
        by_lang = F.when(F.col("lang") == lang, counts) if by_lang is None else by_lang.when(F.col("lang") == lang, counts)
    by_lang = by_lang.otherwise(F.array(*[hit(w).cast("long") for w in common[DEFAULT_LANG]]))
    d = d.withColumn("hits", by_lang).drop("commons", "rest")
    other_words = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    ref = F.when(F.col("lang").isin(list(common)), F.col("lang")).otherwise(F.lit(""))
    return d.select("doc_id", ref.alias("ref"), "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
                    F.array(lower, *[F.col(f"c_{c}") for c in CHAR_CLASSES[1:]]).alias("char_hist"),
                    F.concat("hits", F.array(other_words)).alias("word_hist"))


def _shares(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(hist, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two arrays of shares; columns, not expressions."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: 0.5 * part(x, (x + y) / 2) + 0.5 * part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x)))


def _references(counts: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Sums of both histograms per listed language, and under the empty name over all documents.

    The words under the empty name come from the documents that the default list judges.
    """
    width = max(len(words) for words in common.values()) + 1
    chars = [f"c{i}" for i in range(len(CHAR_CLASSES))]
    words = [f"w{i}" for i in range(width)]
    sums = counts.groupBy("ref").agg(*[F.sum(F.get("char_hist", F.lit(i))).alias(c) for i, c in enumerate(chars)],
                                     *[F.sum(F.get("word_hist", F.lit(i))).alias(w) for i, w in enumerate(words)])
    default = F.col("ref").isin("", DEFAULT_LANG)
    total = sums.agg(*[F.sum(c).alias(c) for c in chars], *[F.sum(F.when(default, F.col(w))).alias(w) for w in words])
    both = sums.filter("ref <> ''").unionByName(total.withColumn("ref", F.lit("")))
    return both.select("ref", F.array(*chars).alias("ref_char_hist"),
                       F.filter(F.array(*words), lambda x: x.isNotNull()).alias("ref_word_hist"))


def quality_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_char_distance: float = MAX_CHAR_DISTANCE,
                   max_word_distance: float = MAX_WORD_DISTANCE, common: dict[str, str] | None = None,
                   id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: base counts, both distances and ``kept``.

    The counts are written once to the shared folder, as the references and the verdicts both read them.
    """
    lists = {lang: words.split() for lang, words in (common or COMMON_WORDS).items()}
    counts = checkpoint(_with_counts(docs, id_col, text_col, lang_col, lists), "quality")
    # at most one row for each listed language and one for all: a bound by construction
    d = counts.join(F.broadcast(_references(counts, lists)), "ref", "left")
    d = d.withColumns({n: _shares(F.col(n)) for n in ("char_hist", "word_hist", "ref_char_hist", "ref_word_hist")})
    d = d.withColumns({"char_distance": F.round(js_distance(F.col("char_hist"), F.col("ref_char_hist")), 9),
                       "word_distance": F.round(js_distance(F.col("word_hist"), F.col("ref_word_hist")), 9)})
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = ((F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance)) | \
        ((F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                    (~base & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance")
