"""Myth knowledge base: matching, quick check, search, statistics.

myths: ``id, ordinal, claim, claim_en, category, era, status, truth, truth_en, origin
struct<source,date,reason>, sources array<struct<title,...>>, keywords, debunked_by, related_myths,
popularity``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from claimspark.functions.names import strip
from claimspark.functions.text import preview
from claimspark.functions.tokens import jaccard, words
from claimspark.operators.skew import skew_join
from claimspark.operators.textjoin import containment_pairs
from claimspark.session import bounded_rows, checkpoint

INLINE_MYTHS = 256


# ---- matching ----------------------------------------------------------------------------------
def _score(claim: Column, claim_words: Column, de: Column, en: Column, de_words: Column, en_words: Column,
           keywords: Column) -> Column:
    either = lambda m: F.contains(claim, m) | F.contains(m, claim)
    number = lambda cond: F.when(cond, 10.0).otherwise(0.0)
    has_en = F.coalesce(en, F.lit("")) != ""
    return (
        number(either(de)) + F.when(has_en, number(either(en))).otherwise(0.0)
        + F.size(F.filter(keywords, lambda k: F.contains(claim, k))) * 2.0
        + jaccard(claim_words, de_words) * 5.0
        + F.when(has_en, jaccard(claim_words, en_words) * 5.0).otherwise(0.0)
    )


def _prepared(myths: DataFrame) -> DataFrame:
    """Lower-cased match columns of the myth table."""
    en = F.lower("claim_en")
    return myths.select(
        "id", "ordinal", F.lower("claim").alias("de"), en.alias("en"),
        F.array_distinct(words(F.col("claim"))).alias("de_words"),
        F.array_distinct(words(F.coalesce(F.col("claim_en"), F.lit("")))).alias("en_words"),
        F.coalesce(F.transform("keywords", F.lower), F.array().cast("array<string>")).alias("keywords"))


def _literal(rows: list[Row]) -> Column:
    text = lambda v: F.lit(v).cast("string")
    items = lambda vs: F.array(*map(F.lit, vs)).cast("array<string>")
    return F.array(*[
        F.struct(text(r["id"]).alias("id"), F.lit(r["ordinal"]).cast("bigint").alias("ordinal"), text(r["de"]).alias("de"),
                 text(r["en"]).alias("en"), items(r["de_words"]).alias("de_words"), items(r["en_words"]).alias("en_words"),
                 items(r["keywords"]).alias("keywords"))
        for r in rows])


def _scored_literal(rows: list[Row]) -> Column:
    """Scores of the claim ``_c``, ``_w`` against the myths of a literal: array of (score, neg, id)."""
    return F.transform(_literal(rows), lambda m: F.struct(
        _score(F.col("_c"), F.col("_w"), m["de"], m["en"], m["de_words"], m["en_words"], m["keywords"]).alias("score"),
        (-m["ordinal"]).alias("neg"), m["id"].alias("id")))


def _match_inline(claims: DataFrame, rows: list[Row], text: str) -> DataFrame:
    """All myths as one literal array: no join and no shuffle.

    The one-element explode keeps the optimizer from repeating the scoring in later filters.
    """
    base = claims.withColumns({"_c": strip(F.lower(text))}).withColumn("_w", F.array_distinct(words(F.col("_c"))))
    best = base.withColumn("_best", F.explode(F.array(F.array_max(_scored_literal(rows))))).drop("_c", "_w")
    return best.withColumns({"myth_id": F.col("_best.id"), "myth_score": F.col("_best.score")}).drop("_best")


def match_candidates(claims: DataFrame, prepared: DataFrame, min_score: float) -> DataFrame:
    """Pairs ``_cid, id`` that can reach the score: a contained text or keyword, or enough shared words.

    A pair without any containment needs 5 * (j_de + j_en) >= min_score, so one Jaccard value of at
    least min_score / 10, so word counts within that factor of each other.
    """
    needle_rows = prepared.select(
        "id", F.explode(F.array_distinct(F.filter(F.concat(F.array("de", "en"), "keywords"), lambda s: F.length(s) > 0))).alias("needle"))
    needles = needle_rows.select("needle").distinct()
    inside = containment_pairs(claims, needles.withColumn("nid", F.col("needle")), "_cid", "_c", "nid", "needle").join(
        needle_rows.withColumnRenamed("needle", "nid"), "nid").select("_cid", "id")

    texts = prepared.select("id", F.explode(F.filter(F.array("de", "en"), lambda s: F.length(s) > 0)).alias("t"))
    longest = texts.agg(F.max(F.length("t")).alias("n")).first()["n"] or 0
    unique = texts.select("t").distinct().withColumn("tid", F.col("t"))
    around = containment_pairs(unique, claims.filter(F.length("_c") <= longest), "tid", "t", "_cid", "_c").join(
        texts.withColumnRenamed("t", "tid"), "tid").select("_cid", "id")

    share = min_score / 10.0
    sides = F.array(F.struct(F.col("de_words").alias("w")), F.struct(F.col("en_words").alias("w")))
    lists = prepared.select("id", F.explode(sides).alias("s")).select("id", F.col("s.w").alias("w"))
    most = lists.agg(F.max(F.size("w")).alias("n")).first()["n"] or 0
    distinct_lists = lists.filter(F.size("w") > 0).withColumn("lid", F.concat_ws(" ", F.array_sort("w")))
    left = claims.filter((F.size("_w") > 0) & (F.size("_w") <= most / share)).select(F.col("_cid").alias("k"), F.col("_w").alias("w"))
    right = distinct_lists.select(F.col("lid").alias("k"), "w").dropDuplicates(["k"])
    rarity = left.select(F.explode("w").alias("word")).unionByName(right.select(F.explode("w").alias("word"))).groupBy("word").agg(
        F.count(F.lit(1)).alias("f"))

    def rare_words(side: DataFrame) -> DataFrame:
        """The words that decide: two lists with the wanted overlap share one of their rarest words.

        A group holds the words of one short list, so its size is bounded.
        """
        ranked = side.select("k", F.explode("w").alias("word")).join(rarity, "word").groupBy("k").agg(
            F.array_sort(F.collect_list(F.struct("f", "word"))).alias("ws"))
        n = F.size("ws")
        return ranked.select("k", n.alias("n"), F.explode(F.slice(F.col("ws"), F.lit(1), (n - F.ceil(n * share - 1e-9) + 1).cast("int"))).alias("x")).select(
            "k", "n", F.col("x.word").alias("word"))

    overlap = rare_words(left).toDF("_cid", "_n", "word").join(rare_words(right).toDF("lid", "_m", "word"), "word").filter(
        F.least("_n", "_m") >= F.greatest("_n", "_m") * share - 1e-9).select("_cid", "lid").distinct()
    similar = overlap.join(distinct_lists.select("lid", "id").distinct(), "lid").select("_cid", "id")
    return inside.unionByName(around).unionByName(similar).distinct()


def _first_of_equal(prepared: DataFrame) -> DataFrame:
    """Of myths that are equal in all matched columns the one that wins their ties, so copies do not multiply the pairs."""
    content = ["de", "en", "de_words", "en_words", "keywords"]
    first = prepared.groupBy(*content, F.col("id").isNull().alias("_nameless")).agg(F.max(F.struct((-F.col("ordinal")).alias("neg"), "ordinal", "id")).alias("b"))
    return first.select("b.id", "b.ordinal", *content)


def _match_joined(claims: DataFrame, prepared: DataFrame, text: str, min_score: float) -> DataFrame:
    """Best myth per claim through equi-joins, and the two cases in which everything pairs with everything:

    an empty claim lies in every myth, so its best is one aggregate over the myths; a myth with an empty text or keyword
    lies in every claim, so those myths are scored as literals, block by block.
    """
    prepared = checkpoint(_first_of_equal(prepared), "myths")
    # One row per distinct text: repeated or null claim ids cannot mix up answers, and copies are matched once.
    base = claims.select(strip(F.lower(text)).alias("_c")).filter("_c IS NOT NULL").distinct()
    base = checkpoint(base.withColumns({"_cid": F.col("_c"), "_w": F.array_distinct(words(F.col("_c")))}), "claims")
    pairs = match_candidates(base.filter(F.length("_c") > 0), prepared, min_score)
    scored = pairs.join(base, "_cid").join(prepared, "id").withColumn("score", _score(
        F.col("_c"), F.col("_w"), F.col("de"), F.col("en"), F.col("de_words"), F.col("en_words"), F.col("keywords")))
    best = scored.groupBy("_cid").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("neg"), "id")).alias("b"))
    out = skew_join(claims.withColumn("_c", strip(F.lower(text))), best.withColumnRenamed("_cid", "_c"), ["_c"], "left")
    out = out.withColumn("_w", F.array_distinct(words(F.col("_c"))))
    for rows in _blocks(prepared.filter((F.col("de") == "") | F.array_contains("keywords", "")), INLINE_MYTHS):
        out = out.withColumn("b", F.greatest("b", F.array_max(_scored_literal(rows))))
    empty = prepared.select(_score(F.lit(""), F.array_distinct(words(F.lit(""))), F.col("de"), F.col("en"), F.col("de_words"), F.col("en_words"), F.col("keywords")).alias("score"),
                            (-F.col("ordinal")).alias("neg"), "id").agg(F.max(F.struct("score", "neg", "id")).alias("b")).first()["b"]
    if empty is not None:
        literal = F.struct(F.lit(empty["score"]).alias("score"), F.lit(empty["neg"]).alias("neg"), F.lit(empty["id"]).alias("id")).cast(out.schema["b"].dataType)
        out = out.withColumn("b", F.when(F.col("_c") == "", literal).otherwise(F.col("b")))
    return out.withColumns({"myth_id": F.col("b.id"), "myth_score": F.col("b.score")}).drop("b", "_c", "_w")


def _blocks(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows in lists of at most ``size``, one list at a time on the driver."""
    rows: list[Row] = []
    for row in df.toLocalIterator():
        rows.append(row)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def match_myths(claims: DataFrame, myths: DataFrame, min_score: float = 2, claim_id: str = "claim_id",
                text: str = "text", inline_limit: int = INLINE_MYTHS) -> DataFrame:
    """Append the best ``myth_id`` and ``myth_score``; null below ``min_score``. First myth wins ties.

    A myth table of at most ``inline_limit`` rows becomes a literal and the match a projection; a
    larger one goes through equi-joins. Both give the same answer.
    """
    prepared = _prepared(myths)
    rows = bounded_rows(prepared, inline_limit)
    if rows is not None and not rows:
        return claims.withColumns({"myth_id": F.lit(None).cast("string"), "myth_score": F.lit(None).cast("double")})
    matched = _match_inline(claims, rows, text) if rows is not None else _match_joined(
        claims, prepared, text, min_score)
    ok = F.col("myth_score") >= min_score
    return matched.withColumns({"myth_id": F.when(ok, F.col("myth_id")), "myth_score": F.when(ok, F.col("myth_score"))})


def quick_check(claims: DataFrame, myths: DataFrame, **options) -> DataFrame:
    """Match plus myth details: ten keywords, five source titles, origin."""
    details = myths.select(
        F.col("id").alias("myth_id"), F.col("claim").alias("myth_claim"), "status", "truth", "category", "era",
        F.col("origin.source").alias("origin"), "popularity",
        F.slice("keywords", 1, 10).alias("keywords"), F.slice("sources.title", 1, 5).alias("sources"))
    hits = match_myths(claims, myths, **options)
    return hits.join(details, "myth_id", "left").withColumn("found", F.col("myth_id").isNotNull())


def myth_analysis(claims: DataFrame, myths: DataFrame, language: str = "language", **options) -> DataFrame:
    """Analysis row of every claim that is a known myth; statements follow the claim's language."""
    m = myths.select(F.col("id").alias("myth_id"), F.col("claim").alias("_de"), F.col("claim_en").alias("_en"), "status",
                     F.col("truth").alias("_truth"), F.col("truth_en").alias("_truth_en"), "origin")
    hits = match_myths(claims, myths, **options).filter(F.col("myth_id").isNotNull()).join(m, "myth_id")
    untrue = F.col("status").isin("false", "myth")
    by_language = lambda de, en: F.when(F.col(language) == "de", F.col(de)).otherwise(
        F.when(F.coalesce(F.col(en), F.lit("")) == "", F.col(de)).otherwise(F.col(en)))
    truth = by_language("_truth", "_truth_en")
    return hits.withColumns({
        "what_is_true": F.when(untrue, truth).otherwise(F.col("_truth")),
        "what_is_false": F.when(untrue, by_language("_de", "_en")),
        "confidence_score": F.lit(0.95),
        "overall_verdict": F.when(untrue, "false").otherwise(F.col("status")),
        "verdict_explanation": F.when(untrue, "This claim is a known historical myth.").otherwise("See detailed analysis."),
        "summary_for_users": truth,
        "recommendation": F.concat(F.lit("Ursprung: "), F.col("origin.source"), F.lit(" ("), F.coalesce(
            F.col("origin.date"), F.lit("unbekannt")), F.lit(")")),
    }).drop("_de", "_en", "_truth", "_truth_en", "origin")


def myth_context(claims: DataFrame, myths: DataFrame, k: int = 3, claim_id: str = "claim_id", text: str = "text") -> DataFrame:
    """Up to k myths whose claim, truth or keyword holds the whole claim, as one text per claim."""
    fields = F.filter(F.concat(F.array("claim", "truth"), F.coalesce("keywords", F.array().cast("array<string>"))), lambda s: s.isNotNull())
    texts = myths.select("id", F.explode(F.transform(fields, F.lower)).alias("t")).select("id", "t").distinct()
    longest = texts.agg(F.max(F.length("t")).alias("n")).first()["n"] or 0
    asked = claims.select(claim_id, F.lower(text).alias("_q"))
    short = asked.filter(F.length("_q") <= longest).select("_q").distinct().withColumn("qid", F.col("_q"))
    unique = texts.select("t").distinct().withColumn("tid", F.col("t"))
    pairs = containment_pairs(unique, short, "tid", "t", "qid", "_q").join(texts.withColumnRenamed("t", "tid"), "tid")
    found = pairs.select("qid", "id").distinct().join(myths.select("id", "ordinal", "claim", "status", "truth"), "id")
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("ordinal"))).filter(F.col("rn") <= k)
    entry = F.concat(F.lit("- "), F.col("claim"), F.lit("\n  Status: "), F.col("status"), F.lit("\n  Wahrheit: "),
                     F.left("truth", F.lit(150)), F.lit("..."))
    listed = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rn", entry.alias("line")))).alias("l")).select(
        F.col("qid").alias("_q"), F.concat(F.lit("RELEVANTE MYTHEN AUS DATENBANK:\n"), F.array_join("l.line", "\n")).alias("context"))
    return asked.join(listed, "_q", "left").select(claim_id, F.coalesce("context", F.lit("")).alias("context"))


def attach_narrative(results: DataFrame, narratives: DataFrame) -> DataFrame:
    """Join the matched narrative by id and flag known propaganda."""
    n = narratives.select(F.col("id").alias("matched_narrative_id"), F.col("name").alias("narrative_name"),
                          F.col("description").alias("narrative_description"))
    return results.join(n, "matched_narrative_id", "left").withColumn(
        "is_known_propaganda", F.coalesce(F.col("narrative_status") == "propaganda", F.lit(False)))


# ---- listing and statistics --------------------------------------------------------------------
def list_myths(myths: DataFrame, category: str | None = None, era: str | None = None, limit: int = 50) -> DataFrame:
    df = myths
    if category:
        df = df.filter(F.col("category") == category)
    if era:
        df = df.filter(F.col("era") == era)
    return df.orderBy(F.desc_nulls_last("popularity"), "ordinal").limit(limit)


def search_myths(myths: DataFrame, q: str, category: str | None = None, era: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Case-insensitive substring search over claim, truth and keywords, in table order."""
    needle = F.lit(q.lower())
    hit = (F.contains(F.lower("claim"), needle) | F.contains(F.lower("truth"), needle)
           | F.exists("keywords", lambda k: F.contains(F.lower(k), needle)))
    df = myths.filter(hit)
    if category:
        df = df.filter(F.col("category") == category)
    if era:
        df = df.filter(F.col("era") == era)
    rows = df.select("id", "ordinal", "claim", "status", preview(F.col("truth")).alias("truth"), "category")
    return rows.orderBy("ordinal").limit(limit) if limit is not None else rows


def search_graph(myths: DataFrame, q: str, limit: int = 10) -> DataFrame:
    return myths.filter(F.contains(F.lower("claim"), F.lit(q.lower()))).orderBy(
        F.col("popularity").desc_nulls_first(), "ordinal").limit(limit).select("id", "claim", "status", "popularity")


def myth_stats(myths: DataFrame) -> DataFrame:
    """Counts by category, era and status and in total: ``dimension, value, n``."""
    named = F.when(F.grouping("category") == 0, "category").when(F.grouping("era") == 0, "era").when(
        F.grouping("status") == 0, "status").otherwise("total")
    c = lambda n: F.col(n)
    return myths.groupingSets([[c("category")], [c("era")], [c("status")], []], c("category"), c("era"), c("status")).agg(
        F.count(F.lit(1)).alias("n"), named.alias("dimension")).select(
        "dimension", F.coalesce("category", "era", "status").alias("value"), "n")


def top_myths(myths: DataFrame, n: int = 5) -> DataFrame:
    return myths.orderBy(F.desc_nulls_last("popularity"), "ordinal").limit(n).select("id", "claim", "popularity")


def list_narratives(narratives: DataFrame) -> DataFrame:
    return narratives.select("id", "name", "name_en", "description", "typical_claims", "purpose")


def lookup(df: DataFrame, ids, column: str = "id") -> DataFrame:
    """Rows by id: one value, or every id of a one-column table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.toDF(column), column, "left_semi")
    return df.filter(F.col(column) == ids)
