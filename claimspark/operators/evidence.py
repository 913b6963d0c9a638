"""Evidence per claim: tier-weighted sources, verdict votes, lookups in fact and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.text import credibility_overall
from claimspark.operators.skew import hot_keys, skew_join
from claimspark.operators.textjoin import containment_pairs

CLAIM_TYPES = ["geographic", "biographical", "historical", "scientific", "quote", "other"]
SUM_UNITS = float(2 ** 56)  # a power of two, so that the product loses no bit of a confidence from 1/16 to 127


def _lookup(pairs: dict, key):
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])[key]


def aggregate_sources(results: DataFrame) -> DataFrame:
    """Verification per claim from its source results; all sums combine map-side.

    ``results``: ``claim_id, ordinal, source_type, tier, found, relevance_score, reliability_score, rating``.
    """
    found = F.col("found")
    weight = F.when(found, F.col("reliability_score"))
    checked = results.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("sources_checked"),
        F.count_if(found).alias("sources_found"),
        F.min(F.when(found & F.col("tier").isin(L.TIERS), F.col("tier"))).alias("highest_tier"),
        F.sum(weight).alias("_w"), F.sum(weight * F.col("relevance_score")).alias("_wr"),
        F.min_by("rating", F.when(found & (F.col("source_type") == "fact_check") & (F.coalesce("rating", F.lit("")) != ""),
                                  F.col("ordinal"))).alias("fact_check_rating"),
    )
    mean = F.when(F.col("_w") > 0, F.col("_wr") / F.col("_w")).otherwise(0.0)
    bonus = F.coalesce(_lookup(L.TIER_BONUS, F.col("highest_tier")), F.lit(0.0))
    scored = checked.withColumn("_c", F.when(F.col("sources_found") > 0, F.round(F.least(F.lit(1.0), mean + bonus), 9)).otherwise(0.0))
    c = F.col("_c")
    none = F.col("sources_found") == 0
    summary = F.concat_ws(
        " ", F.concat(F.lit("Found in "), F.col("sources_found").cast("string"), F.lit(" authoritative sources.")),
        F.concat(F.lit("Highest tier: "), _lookup(L.TIER_NAMES, F.col("highest_tier")), F.lit(".")),
        F.concat(F.lit("Fact-check rating: "), F.col("fact_check_rating"), F.lit(".")))
    recommendation = (
        F.when(none, "This claim could not be verified against authoritative sources. Additional research recommended.")
        .when(c >= 0.8, "High confidence from authoritative sources. This claim is well-documented.")
        .when(c >= 0.6, "Moderate support from authoritative sources. Some verification achieved.")
        .when(c >= 0.4, "Limited authoritative support. Additional verification recommended.")
        .otherwise("Minimal authoritative support found. Treat this claim with caution."))
    return scored.select(
        "claim_id", (c > 0.5).alias("verified"), F.round(c, 3).alias("confidence"), "sources_checked", "sources_found",
        "highest_tier", "fact_check_rating",
        F.when(none, "No authoritative sources found for this claim.").otherwise(summary).alias("summary"),
        recommendation.alias("recommendation"))


def weighted_votes(votes: DataFrame) -> DataFrame:
    """Turn raw votes (``kind`` model / structured / local, ``raw_confidence``) into weighted confidences."""
    w = L.VOTE_WEIGHTS
    raw = F.coalesce("raw_confidence", F.lit(0.5))
    return votes.withColumn("confidence", F.when(F.col("kind") == "structured", w["structured"]).when(
        F.col("kind") == "local", raw * w["local"]).otherwise(raw * w["model"]))


def merge_votes(claims: DataFrame, votes: DataFrame) -> DataFrame:
    """One verdict per claim: summed confidence for true against false and misleading, ties are false.

    The confidences are summed as whole numbers of ``1 / SUM_UNITS`` and rounded once, which is exact in any order: the
    same votes give the same verdict however they are dealt over tasks.
    """
    counted = lambda *verdicts: F.when(F.col("verdict").isin(*verdicts), F.col("confidence")).otherwise(0.0)
    exact_sum = lambda c: F.sum((c * SUM_UNITS).cast("bigint").cast("decimal(20,0)")).cast("double") / SUM_UNITS
    told = (F.coalesce("explanation", F.lit("")) != "") & (F.col("confidence") > 0.5)
    last = F.when(told, F.col("ordinal"))
    merged = votes.groupBy("claim_id").agg(
        exact_sum(counted("true")).alias("_t"), exact_sum(counted("false", "misleading")).alias("_f"),
        F.count(F.lit(1)).alias("n_votes"),
        F.max_by(F.struct("explanation", "correction"), last).alias("_last"),
        F.max_by("claim_type", F.when(told & F.col("claim_type").isin(CLAIM_TYPES), F.col("ordinal"))).alias("_type"))
    total = F.col("_t") + F.col("_f")
    verdict = F.when(F.col("n_votes").isNull() | (total == 0), "unverifiable").when(F.col("_t") > F.col("_f"), "true").otherwise("false")
    confidence = F.when(F.col("n_votes").isNull(), 0.0).when(total == 0, 0.3).otherwise(
        F.least(F.lit(0.95), F.greatest("_t", "_f") / total))
    explanation = F.when(F.col("n_votes").isNull(), "Keine Quelle konnte die Behauptung pruefen.").otherwise(
        F.coalesce("_last.explanation", F.lit("Basierend auf verfuegbaren Quellen.")))
    return claims.select("claim_id").join(merged, "claim_id", "left").select(
        "claim_id", verdict.alias("verdict"), _lookup(L.VERDICT_LABELS, verdict).alias("verdict_label"),
        confidence.alias("confidence"), explanation.alias("explanation"),
        F.when(verdict == "false", F.col("_last.correction")).alias("correction"),
        F.coalesce("_type", F.lit("other")).alias("claim_type"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"))


def article_verdict(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """Verdict per article from ``claims(article_id, fact_status)``."""
    flags = claims.groupBy("article_id").agg(
        F.bool_or(F.col("fact_status").isin("false", "myth")).alias("_bad"),
        F.bool_and(F.col("fact_status") == "confirmed").alias("_good"), F.count(F.lit(1)).alias("n_claims"))
    return articles.select("article_id").join(flags, "article_id", "left").select(
        "article_id", F.coalesce("n_claims", F.lit(0)).alias("n_claims"),
        F.when(F.col("_bad"), "false").when(F.col("_good"), "historically_accurate").otherwise("unverifiable").alias("verdict"))


def top_n_per_key(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """First n rows per key; each partition is cut to n per key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def evidence_context(entities: DataFrame, records: DataFrame, facts: DataFrame) -> DataFrame:
    """Text block per claim: three entities, one authority record each, five facts each.

    ``entities``: ``claim_id, ordinal, entity``; ``records``: ``entity, ordinal, label, description,
    birth_date, death_date``; ``facts``: ``entity, ordinal, claim, value``.
    """
    few = top_n_per_key(entities, ["claim_id"], ["ordinal"], 3)
    record = records.groupBy("entity").agg(
        F.min_by(F.struct("label", "description", "birth_date", "death_date"), "ordinal").alias("r"))
    lines = F.array(
        F.concat(F.lit("[GND] "), F.col("r.label")), F.concat(F.lit("  - "), F.col("r.description")),
        F.concat(F.lit("  - Geboren: "), F.col("r.birth_date").cast("string")),
        F.concat(F.lit("  - Gestorben: "), F.col("r.death_date").cast("string")))
    from_records = few.join(record, "entity").select(
        "claim_id", "ordinal", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("pos", "line"))
    five = top_n_per_key(facts, ["entity"], ["ordinal"], 5).select("entity", F.col("ordinal").alias("_fo"), "claim", "value")
    from_facts = few.join(five, "entity").select(
        "claim_id", "ordinal", (F.lit(10) + F.col("_fo")).cast("int").alias("pos"),
        F.concat(F.lit("[Wikidata] "), F.col("claim"), F.lit(": "), F.col("value")).alias("line"))
    # At most 3 * (4 + 5) lines per claim reach the list.
    text = from_records.unionByName(from_facts).groupBy("claim_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "pos", "line")))["line"], "\n").alias("context"))
    return entities.select("claim_id").distinct().join(text, "claim_id", "left").select(
        "claim_id", F.coalesce("context", F.lit("Keine autoritativen Daten gefunden.")).alias("context"))


def verify_person_facts(claims: DataFrame, entity_facts: DataFrame, records: DataFrame) -> DataFrame:
    """Check ``claims(claim_id, person, claim_type, claimed_value)`` against the property table.

    The first record of the person answers birth dates the property table does not know; such an
    answer never verifies.
    """
    target = F.coalesce(_lookup(L.CLAIM_TYPE_PROPERTIES, F.col("claim_type")), F.col("claim_type"))
    known = entity_facts.groupBy(F.col("entity").alias("person"), F.col("property").alias("_target")).agg(
        F.min_by(F.struct("value", "confidence", "source"), "ordinal").alias("f"))
    backup = records.groupBy(F.col("name").alias("person")).agg(F.min_by("birth_date", "ordinal").alias("_birth"))
    joined = skew_join(claims.withColumn("_target", target), known, ["person", "_target"], "left")
    joined = skew_join(joined, backup, ["person"], "left", hot=hot_keys(claims, ["person"]))
    has = F.coalesce(F.col("f.value"), F.lit("")) != ""
    fallback = ~has & (F.col("claim_type") == "birth_date") & F.col("_birth").isNotNull()
    return joined.select(
        "claim_id", "person", "claim_type", "claimed_value",
        F.when(has, F.col("f.value")).when(fallback, F.col("_birth").cast("string")).alias("actual"),
        F.coalesce(has & F.contains(F.lower("f.value"), F.lower("claimed_value")), F.lit(False)).alias("verified"),
        F.when(has, F.col("f.confidence")).when(fallback, 0.9).otherwise(F.coalesce("f.confidence", F.lit(0.0))).alias("confidence"),
        F.when(has, F.col("f.source")).when(fallback, "GND").alias("source"))


# The two sentence forms that can be checked by lookup.
LOCATED_PATTERN = r"([\p{L}\p{N}_]+)\s+liegt\s+in\s+([\p{L}\p{N}_]+)"
CAPITAL_PATTERN = r"[Hh]auptstadt\s+von\s+([\p{L}\p{N}_]+)\s+ist\s+([\p{L}\p{N}_]+)"


def verify_pattern_claims(claims: DataFrame, geo_facts: DataFrame) -> DataFrame:
    """Claims of the form "X liegt in Y" or "Hauptstadt von X ist Y" against ``geo_facts(pattern, subject, actual)``.

    Output has a row per claim that fits a pattern and whose subject is known.
    """
    t = F.col("text")
    part = lambda p, i: F.regexp_extract(t, p, i)
    located = F.struct(F.lit("country_continent").alias("pattern"), part(LOCATED_PATTERN, 1).alias("subject"),
                       part(LOCATED_PATTERN, 2).alias("object"))
    capital = F.struct(F.lit("capital").alias("pattern"), part(CAPITAL_PATTERN, 1).alias("subject"),
                       part(CAPITAL_PATTERN, 2).alias("object"))
    parsed = claims.withColumn("p", F.when(t.rlike(LOCATED_PATTERN), located).when(t.rlike(CAPITAL_PATTERN), capital))
    parsed = parsed.filter(F.col("p").isNotNull()).select("claim_id", "p.pattern", "p.subject", "p.object")
    facts = geo_facts.groupBy("pattern", "subject").agg(F.min("actual").alias("actual"))
    explanation = F.when(
        F.col("pattern") == "capital",
        F.concat(F.lit("Die Hauptstadt von "), F.col("subject"), F.lit(" ist "), F.col("actual"), F.lit("."))
    ).otherwise(F.concat(F.col("subject"), F.lit(" liegt in "), F.col("actual"), F.lit(".")))
    return parsed.join(facts, ["pattern", "subject"]).select(
        "claim_id", "pattern", "subject", "object", "actual",
        (F.lower("actual") == F.lower("object")).alias("confirms"), explanation.alias("explanation"))


def credibility(texts: DataFrame, verifications: DataFrame | None = None) -> DataFrame:
    """Combine ``confidence`` and ``propaganda_score`` of ``texts(claim_id, ...)`` with verification."""
    if verifications is not None:
        v = verifications.select("claim_id", F.col("confidence").alias("verification"))
        texts = texts.join(v, "claim_id", "left")
    else:
        texts = texts.withColumn("verification", F.lit(None).cast("double"))
    score, band = credibility_overall(F.col("confidence"), F.col("propaganda_score"), F.col("verification"))
    return texts.withColumns({"overall_score": F.round(score, 3), "assessment": band})


def first_summary(claims: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summary of the first capitalised word of more than three letters that has one."""
    found = claims.select("claim_id", F.posexplode(F.split("text", r"(?U)\s+")).alias("pos", "title")).filter(
        (F.length("title") > 3) & F.col("title").rlike(r"^\p{Lu}"))
    return found.join(summaries.filter(F.coalesce("summary", F.lit("")) != ""), "title").groupBy("claim_id").agg(
        F.min_by("title", "pos").alias("title"), F.min_by("summary", "pos").alias("summary"))


def search_entities(queries: DataFrame, entities: DataFrame, labels: DataFrame, entity_types: list[str], k: int = 10,
                    languages: tuple[str, ...] = ("en", "de")) -> DataFrame:
    """Entities of the given types whose label holds the query text, ignoring case; at most k per query.

    ``queries``: ``query_id, name``; ``entities``: ``entity_id, entity_type`` and optional attribute
    columns; ``labels``: ``entity_id, label, lang``.
    """
    typed = entities.filter(F.col("entity_type").isin(entity_types))
    spoken = labels.filter(F.col("lang").isin(list(languages))).join(typed.select("entity_id"), "entity_id", "left_semi")
    texts = spoken.select(F.lower("label").alias("t")).distinct().withColumn("tid", F.col("t"))
    asked = queries.select(F.lower("name").alias("q")).distinct().withColumn("qid", F.col("q"))
    pairs = containment_pairs(texts, asked, "tid", "t", "qid", "q")
    hits = (pairs.join(spoken.select("entity_id", F.lower("label").alias("tid")), "tid")
            .join(queries.select("query_id", F.lower("name").alias("qid")), "qid")
            .select("query_id", "entity_id").distinct())
    few = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("entity_id"))).filter(F.col("rank") <= k)
    return few.join(typed, "entity_id")


def mine_relations(statements: DataFrame, labels: DataFrame, kind: str, classes: dict[str, str]) -> DataFrame:
    """Rows for fact sentences from a statement dump.

    ``statements``: ``subject, property, value``; ``labels``: ``entity_id, label``; ``classes`` names
    the properties and classes: ``instance_of, country, human, continent, capital, sitelinks, birth, death``.
    ``kind``: ``countries`` and ``capitals`` give ``a, b``; ``persons`` gives ``person, birth_year, death_year``.
    """
    name = labels.select("entity_id", "label")
    has = lambda prop: statements.filter(F.col("property") == prop)
    of_class = lambda cls: has(classes["instance_of"]).filter(F.col("value") == cls).select("subject").distinct()
    if kind in ("countries", "capitals"):
        prop = classes["continent" if kind == "countries" else "capital"]
        pairs = has(prop).join(of_class(classes["country"]), "subject", "left_semi").select("subject", "value")
        return (pairs.join(name.toDF("subject", "a"), "subject").join(name.toDF("value", "b"), "value")
                .select("a", "b").distinct())
    notable = has(classes["sitelinks"]).filter(F.col("value").try_cast("int") > 50).select("subject").distinct()
    people = of_class(classes["human"]).join(notable, "subject", "left_semi")
    year = lambda prop, out: has(prop).select("subject", F.year(F.try_to_date("value", "yyyy-MM-dd")).cast("string").alias(out))
    return (people.join(year(classes["birth"], "birth_year"), "subject")
            .join(year(classes["death"], "death_year"), "subject", "left")
            .join(name.toDF("subject", "person"), "subject")
            .select("person", "birth_year", "death_year").distinct())
