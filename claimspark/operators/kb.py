"""Growing the knowledge base: sentences, negatives, novelty, samples, candidates.

facts: ``id, claim, is_true, explanation, source, claim_type, entities array<string>, confidence``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.names import stable_id
from claimspark.functions.text import guess_category, guess_era
from claimspark.session import shared_scratch

FACT_COLUMNS = ["id", "claim", "is_true", "explanation", "source", "claim_type", "entities", "confidence"]
_LETTERS4 = r"(?<![\p{L}\p{N}_])[a-zäöüß]{4,}(?![\p{L}\p{N}_])"


def resolved_labels(df: DataFrame, *columns: str, mode: str = "strict") -> DataFrame:
    """Drop blank labels and unresolved ids; ``mode='broad'`` drops every label starting with Q."""
    for name in columns:
        c = F.col(name)
        unresolved = c.startswith("Q") if mode == "broad" else c.rlike(r"^Q[0-9]+$")
        df = df.filter((F.coalesce(c, F.lit("")) != "") & ~unresolved)
    return df


def _facts(df: DataFrame, id_: Column, claim: Column, explanation: Column, claim_type: str, entities: Column,
           source: str = "wikidata", is_true: bool = True) -> DataFrame:
    return df.select(id_.alias("id"), claim.alias("claim"), F.lit(is_true).alias("is_true"), explanation.alias("explanation"),
                     F.lit(source).alias("source"), F.lit(claim_type).alias("claim_type"), entities.alias("entities"),
                     F.lit(1.0).alias("confidence"))


def country_facts(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _facts(pairs, stable_id("geo_", a, b), F.concat(a, F.lit(" liegt in "), b),
                  F.concat(a, F.lit(" ist ein Land auf dem Kontinent "), b, F.lit(".")), "geographic", F.array(a, b))


def capital_facts(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _facts(pairs, stable_id("cap_", a, b), F.concat(F.lit("Die Hauptstadt von "), a, F.lit(" ist "), b),
                  F.concat(b, F.lit(" ist die Hauptstadt von "), a, F.lit(".")), "geographic", F.array(a, b))


def person_facts(people: DataFrame) -> DataFrame:
    """Birth sentence for everyone, death sentence where the death year differs from the birth year."""
    p, y = F.col("person"), F.col("y")
    born = F.struct(F.lit("b").alias("k"), F.col("birth_year").alias("y"))
    died = F.when(F.col("death_year") != F.col("birth_year"), F.struct(F.lit("d").alias("k"), F.col("death_year").alias("y")))
    rows = people.filter(F.coalesce("birth_year", F.lit("")) != "").select(
        "person", F.explode(F.filter(F.array(born, died), lambda s: s.isNotNull())).alias("s")).select("person", "s.k", "s.y")
    is_birth = F.col("k") == "b"
    return _facts(
        rows, F.when(is_birth, stable_id("bio_", p, y)).otherwise(stable_id("bio_", p, F.lit("death"), y)),
        F.when(is_birth, F.concat(p, F.lit(" wurde "), y, F.lit(" geboren"))).otherwise(F.concat(p, F.lit(" starb "), y)),
        F.when(is_birth, F.concat(p, F.lit(" wurde im Jahr "), y, F.lit(" geboren."))).otherwise(
            F.concat(p, F.lit(" starb im Jahr "), y, F.lit("."))),
        "biographical", F.array(p, y))


def misconception_facts(table: DataFrame) -> DataFrame:
    """False facts from ``claim, truth, category``."""
    c = F.col("claim")
    return table.select(
        stable_id("misc_", c).alias("id"), "claim", F.lit(False).alias("is_true"), F.col("truth").alias("explanation"),
        F.lit("wikipedia").alias("source"), F.col("category").alias("claim_type"),
        F.array().cast("array<string>").alias("entities"), F.lit(1.0).alias("confidence"))


def negative_seeds(kb: DataFrame, n: int | None = None) -> DataFrame:
    """True geographic facts none of whose entities a generated fact uses; all, or the first n by id.

    Works per entity with an anti-join, so no entity list is ever held in one place.
    """
    used = kb.filter(F.col("source") == "generated").select(F.explode("entities").alias("e")).distinct()
    geo = kb.filter(F.col("is_true") & (F.col("claim_type") == "geographic"))
    touched = geo.select("id", F.explode("entities").alias("e")).join(used, "e", "left_semi").select("id").distinct()
    free = geo.join(touched, "id", "left_anti")
    return free.orderBy("id").limit(n) if n is not None else free


def hash_pick(items: Column, key: Column) -> Column:
    """A repeatable pick from an array by the md5 of a key."""
    number = F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("bigint")
    return F.element_at(items, (F.pmod(number, F.size(items)) + 1).cast("int"))


def negatives(seeds: DataFrame, swaps: dict[str, list[str]] | None = None) -> DataFrame:
    """False "X liegt in Z" facts: the second entity swapped for another continent."""
    swaps = swaps or L.CONTINENT_SWAPS
    table = F.create_map(*[x for k, v in swaps.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    place, real = F.get("entities", F.lit(0)), F.get("entities", F.lit(1))
    df = seeds.filter((F.col("claim_type") == "geographic") & (F.size("entities") >= 2)).withColumn(
        "_alt", table[real]).filter(F.col("_alt").isNotNull()).withColumn("_wrong", hash_pick(F.col("_alt"), F.col("id")))
    wrong = F.col("_wrong")
    return _facts(df, stable_id("adv_", place, wrong), F.concat(place, F.lit(" liegt in "), wrong),
                  F.concat(F.lit("Falsch. "), place, F.lit(" liegt in "), real, F.lit(", nicht in "), wrong, F.lit(".")),
                  "geographic", F.array(place, wrong), "generated", False)


def new_facts(candidates: DataFrame, kb: DataFrame) -> DataFrame:
    """Candidates that the knowledge base lacks, one row each.

    The short id is for display and may clash; a fact is known only if its id and its whole claim are.
    """
    return candidates.dropDuplicates(["id", "claim"]).join(kb.select("id", "claim"), ["id", "claim"], "left_anti").select(*candidates.columns)


def grow_kb(kb: DataFrame, mined: DataFrame, misconceptions: DataFrame, max_negatives: int | None = None,
            swaps: dict[str, list[str]] | None = None) -> DataFrame:
    """All new facts of one growth run: mined, misconceptions, then negatives over the grown base."""
    fresh = new_facts(mined.select(*FACT_COLUMNS).unionByName(misconceptions.select(*FACT_COLUMNS)), kb)
    grown = kb.select(*FACT_COLUMNS).unionByName(fresh)
    extra = new_facts(negatives(negative_seeds(grown, max_negatives), swaps), grown)
    return fresh.unionByName(extra)


def growth_stats(fresh: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("source") == "generated", "adversarial").when(F.col("source") == "wikipedia", "misconceptions")
        .when((F.col("claim_type") == "geographic") & F.contains("claim", F.lit("Hauptstadt")), "capitals")
        .when(F.col("claim_type") == "geographic", "geographic").when(F.col("claim_type") == "biographical", "biographical"))
    return fresh.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("kind").isNotNull())


def fact_stats(facts: DataFrame) -> DataFrame:
    """Counts by source, type and verdict and in total: ``dimension, value, n``."""
    df = facts.withColumn("verdict", F.when(F.col("is_true"), "true").otherwise("false"))
    dims = ["source", "claim_type", "verdict"]
    named = F.lit("total")
    for d in reversed(dims):
        named = F.when(F.grouping(d) == 0, d).otherwise(named)
    return df.groupingSets([[F.col(d)] for d in dims] + [[]], *map(F.col, dims)).agg(
        F.count(F.lit(1)).alias("n"), named.alias("dimension")).select("dimension", F.coalesce(*dims).alias("value"), "n")


def sample_facts(facts: DataFrame, source: str | None = None, limit: int = 20) -> DataFrame:
    """The first ``limit`` facts by id, of one source if it is given."""
    df = facts.filter(F.col("source") == source) if source else facts
    return df.orderBy("id").limit(limit)


def balanced_sample(facts: DataFrame, limit: int = 1000, seed: str = "0") -> DataFrame:
    """Equally many true and false facts in hash order, at most ``limit // 2`` of each.

    Hashes are uniform and the class sizes are known, so a hash bound that about twice the wanted
    rows pass is tried first; only if too few pass are all rows ranked. The result is the same.
    """
    counts = facts.agg(F.count_if(F.col("is_true")).alias("t"), F.count_if(~F.col("is_true")).alias("f")).first()
    n = min(counts["t"], counts["f"], limit // 2)
    hashed = facts.withColumn("_h", F.md5(F.concat("id", F.lit(seed))))

    def bound(size: int) -> str:
        return format(min(16**8 - 1, int(16**8 * (2 * n + 100) / max(1, size))), "08x")

    low = F.when(F.col("is_true"), bound(counts["t"])).otherwise(bound(counts["f"]))
    some = hashed.filter(F.left("_h", F.lit(8)) <= low)
    enough = some.agg(F.count_if(F.col("is_true")).alias("t"), F.count_if(~F.col("is_true")).alias("f")).first()
    pool = some if min(enough["t"], enough["f"]) >= n else hashed
    order = Window.partitionBy("is_true").orderBy("_h", "id")
    return pool.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn", "_h")


def training_data(facts: DataFrame, limit: int = 1000, claim_type: str | None = None, only_true: bool = False,
                  only_false: bool = False, balanced: bool = False) -> DataFrame:
    """Training rows: the filters first, then the balanced sample or the first ``limit`` by id."""
    df = facts.filter(F.col("claim_type") == claim_type) if claim_type else facts
    if only_true:
        df = df.filter(F.col("is_true"))
    if only_false:
        df = df.filter(~F.col("is_true"))
    return balanced_sample(df, limit) if balanced else df.orderBy("id").limit(limit)


# ---- learning from analyses --------------------------------------------------------------------
def learnable(analyses: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Analyses with a clear verdict, at least one claim and a mean confidence at the bound.

    ``analyses``: ``id, source_text, overall_verdict, summary_for_users, claims
    array<struct<original_claim,confidence_score>>``.
    """
    total = F.aggregate("claims", F.lit(0.0), lambda acc, c: acc + F.coalesce(c["confidence_score"], F.lit(0.0)))
    n = F.size(F.coalesce("claims", F.expr("cast(array() as array<struct<original_claim:string,confidence_score:double>>)")))
    return analyses.filter(F.col("overall_verdict").isin("false", "myth", "propaganda") & (n > 0)).withColumn(
        "mean_confidence", total / n).filter(F.col("mean_confidence") >= min_confidence)


def top_keywords(texts: DataFrame, k: int = 10, text_id: str = "id", text: str = "text") -> DataFrame:
    """Most frequent words of four or more letters per text, ties by first position.

    The texts are dealt out by id once, so that counting and ranking need no shuffle of the words, which take several
    times the room of the texts.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS4), F.lit(0))
    dealt = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("text")).repartition("text_id")
    w = dealt.select("text_id", F.posexplode(found).alias("pos", "keyword")).filter(
        ~F.col("keyword").isin(L.KEYWORD_STOPWORDS))
    counts = w.groupBy("text_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy("text_id").orderBy(F.desc("n"), "first_pos")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "text_id", "keyword", "n", "rank")


def build_candidates(analyses: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Review candidates from learnable analyses."""
    df = learnable(analyses, min_confidence)
    words = top_keywords(df, 10, "id", "source_text").groupBy("text_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"]).alias("keywords"))
    t = F.col("source_text")
    return df.join(words.withColumnRenamed("text_id", "id"), "id", "left").select(
        "id", F.coalesce(F.get("claims", F.lit(0))["original_claim"], t).alias("claim"),
        F.coalesce("summary_for_users", F.lit("")).alias("truth"), guess_category(t).alias("category"),
        guess_era(t).alias("era"), F.when(F.col("overall_verdict") == "myth", "myth").otherwise("false").alias("status"),
        F.col("mean_confidence").alias("confidence_score"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.lit("pending").alias("review_status"))


def pending(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("review_status") == "pending")


def learning_stats(candidates: DataFrame) -> DataFrame:
    status = F.col("review_status")
    return candidates.agg(F.count(F.lit(1)).alias("total_candidates"), F.count_if(status == "pending").alias("pending_review"),
                          F.count_if(status == "approved").alias("approved"), F.count_if(status == "rejected").alias("rejected"))


def apply_reviews(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Latest decision per candidate; edits replace claim and truth.

    ``events``: ``candidate_id, action (approve/reject), notes, modified_claim, modified_truth, ts``.
    """
    latest = events.groupBy(F.col("candidate_id").alias("id")).agg(
        F.max_by(F.struct("action", "notes", "modified_claim", "modified_truth", "ts"), "ts").alias("e"))
    df = candidates.join(latest, "id", "left")
    edited = lambda new, old: F.when(F.col("e.action") == "approve", F.coalesce(F.nullif(F.col(f"e.{new}"), F.lit("")), F.col(old))).otherwise(F.col(old))
    return df.withColumns({
        "claim": edited("modified_claim", "claim"), "truth": edited("modified_truth", "truth"),
        "review_status": F.when(F.col("e.action") == "approve", "approved").when(F.col("e.action") == "reject", "rejected").otherwise(F.col("review_status")),
        "reviewer_notes": F.col("e.notes"), "reviewed_at": F.col("e.ts"),
    }).drop("e")


def promote_candidates(candidates: DataFrame, myths: DataFrame) -> DataFrame:
    """Approved candidates as myth rows, unless the myth table has them already."""
    rows = candidates.filter(F.col("review_status") == "approved").select(
        F.concat(F.lit("learned_"), "id").alias("id"), "claim", "truth", "category", "era", "status", "keywords",
        F.lit(50).alias("popularity"))
    return rows.join(myths.select("id"), "id", "left_anti")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) under a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


@dataclass(frozen=True)
class Pages:
    """Rows stored in ranges of a total order, with the number of rows of each range."""

    rows: DataFrame
    order: list[str]
    counts: list[tuple[int, int]]

    def ranges(self, offset: int, limit: int) -> tuple[list[int], int]:
        """The ranges that hold rows [offset, offset + limit) and the number of rows before them."""
        touched, before, seen = [], 0, 0
        for part, n in self.counts:
            if seen + n <= offset:
                before = seen + n
            elif seen < offset + limit:
                touched.append(part)
            seen += n
        return touched, before

    def read(self, offset: int, limit: int) -> DataFrame:
        """Rows [offset, offset + limit): only the files of their ranges are read."""
        touched, before = self.ranges(offset, limit)
        found = self.rows.filter(F.col("_part").isin(touched)) if touched else self.rows.filter(F.lit(False))
        return page(found, self.order, offset - before, limit).drop("_part")


def store_pages(df: DataFrame, order: list[str], rows_per_part: int = 1_000_000, max_parts: int = 20_000) -> Pages:
    """Write rows once by ranges of ``order`` (column names, ascending, null first), so that deep pages cost what shallow ones do.

    ``order`` must be total. Beyond ``rows_per_part * max_parts`` rows the ranges grow instead of their number: the driver
    holds ``max_parts`` counts at most.
    """
    parts = max(1, min(max_parts, -(-df.count() // rows_per_part)))
    path = shared_scratch(df.sparkSession, "pages")
    df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(path)
    rows = df.sparkSession.read.schema(df.schema.add("_part", "integer")).parquet(path)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    return Pages(rows, list(order), [(r["_part"], r["n"]) for r in counts])


def page_after(df: DataFrame, order: list[str], last: list, limit: int) -> DataFrame:
    """The ``limit`` rows behind the row whose order values are ``last``; the bound on the first column reaches the scan."""
    key = F.struct(*order)
    behind = key > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, last)])
    if last[0] is not None:
        behind &= F.col(order[0]) >= F.lit(last[0])
    return df.filter(behind).orderBy(*order).limit(limit).drop("_part")


def misconceptions_table(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "claim string, truth string, category string")
