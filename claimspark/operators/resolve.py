"""Entity resolution of claim nodes against fact nodes, and relationship verification.

Tables
  claim nodes: ``claim_id, ordinal, name, node_type`` (unique by claim_id + ordinal)
  facts:       ``fact_id, ordinal, name, node_type, aliases`` (node_type null = type not recorded)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.names import levenshtein_ratio, normalize_name, soundex4, strip
from claimspark.operators.skew import skew_join
from claimspark.operators.textjoin import containment_pairs, edit_pairs
from claimspark.session import checkpoint, checkpoint_slices

ISSUE_COLUMNS = ["claim_id", "issue_type", "severity", "message", "claim_entity", "claim_value", "fact_value", "confidence"]


def typed_facts(facts: DataFrame) -> DataFrame:
    """One row per fact and type it may match: an untyped fact matches all types, an unknown type none."""
    types = F.when(
        F.coalesce(F.col("node_type"), F.lit("")) == "", F.array(*map(F.lit, L.NODE_TYPES))
    ).otherwise(F.array("node_type"))
    return facts.withColumn("node_type", F.explode(types)).filter(F.col("node_type").isin(L.NODE_TYPES))


def fact_candidates(claim_nodes: DataFrame, facts: DataFrame, k: int | None = None) -> DataFrame:
    """Facts of the same type with an equal, aliased, containing or contained name (case-sensitive).

    All of them, or the first ``k`` per claim name by fact ordinal. Works on distinct (type, name) pairs so copies of
    a claim name cost one row; those pairs are written once because both directions read them
    several times. Output: ``node_type, claim_name, fact_id``.
    """
    key = ["node_type", "claim_name"]
    names = checkpoint(claim_nodes.select("node_type", F.col("name").alias("claim_name")).distinct(), "claim-names")
    fact_names = checkpoint(facts.select("node_type", F.col("name").alias("_fname")).filter(
        F.length("_fname") > 0).distinct(), "fact-names")

    inside = containment_pairs(names, fact_names, "claim_name", "claim_name", "_fname", "_fname", ["node_type"], short=True)
    around = containment_pairs(fact_names, names, "_fname", "_fname", "claim_name", "claim_name", ["node_type"], short=True)
    hits = inside.unionByName(around).join(
        facts.select("node_type", F.col("name").alias("_fname"), "fact_id", "ordinal"), ["node_type", "_fname"]).select(*key, "fact_id", "ordinal")
    by_alias = (
        facts.select("node_type", "fact_id", "ordinal", F.explode("aliases").alias("claim_name"))
        .join(names, key).select(*key, "fact_id", "ordinal")
    )
    pairs = hits.unionByName(by_alias).groupBy(*key, "fact_id").agg(F.min("ordinal").alias("ordinal"))
    if k is not None:
        order = Window.partitionBy(*key).orderBy("ordinal", "fact_id")
        pairs = pairs.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
    return pairs.select(*key, "fact_id")


def similarity_candidates(claim_nodes: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """Every fact that can reach the threshold: equal, aliased, within the edit ratio or sounding alike."""
    claims = checkpoint(claim_nodes.select("node_type", F.col("name").alias("claim_name")).distinct().withColumn(
        "text", normalize_name(F.col("claim_name"))), "claim-names")
    named = checkpoint(facts.withColumn("text", normalize_name(F.col("name"))), "fact-names")
    near = edit_pairs(claims, named, threshold, ["node_type"])
    fuzzy = (
        claims.withColumnRenamed("text", "left_text").join(near, ["node_type", "left_text"])
        .join(named.select("node_type", F.col("text").alias("right_text"), "fact_id"), ["node_type", "right_text"])
        .select("node_type", "claim_name", "fact_id")
    )
    equal = claims.join(named.select("node_type", "text", "fact_id"), ["node_type", "text"])
    alias = claims.join(
        facts.select("node_type", "fact_id", F.explode("aliases").alias("_a")).select(
            "node_type", "fact_id", normalize_name(F.col("_a")).alias("text")),
        ["node_type", "text"])
    parts = [fuzzy, *(p.select("node_type", "claim_name", "fact_id") for p in (equal, alias))]
    if threshold <= 0.7:
        sound = claims.withColumn("_s", soundex4(F.col("claim_name"))).join(
            facts.select("node_type", "fact_id", soundex4(F.col("name")).alias("_s")), ["node_type", "_s"])
        parts.append(sound.select("node_type", "claim_name", "fact_id"))
    return reduce(DataFrame.unionByName, parts).distinct()


def resolve_entities(
    claim_nodes: DataFrame, facts: DataFrame, threshold: float = 0.8, candidates: str = "contained", k: int | None = None,
    store: bool = False,
) -> DataFrame:
    """Matches with score and method per claim node, best first.

    ``candidates='contained'`` scores every fact whose name or alias equals, holds or lies in the claim's name
    (with ``k`` only the first k of them, which may lose an exact one), ``'all'`` finds every match at the threshold. Output: ``claim_id, claim_ordinal, claim_name, claim_type, fact_id,
    fact_name, fact_type, match_score, match_method, rank``. With ``store`` they are written, the claims in slices;
    ``claim_nodes`` is then a stored table.
    """
    # Names are normalised once per fact and once per pair and stored: within the join below, whose condition and
    # result both use them, they would be computed several times for every pair.
    facts = facts.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    pool = checkpoint(typed_facts(facts.select(
        "fact_id", "ordinal", "name", "node_type", "aliases", normalize_name(F.col("name")).alias("_fact"),
        F.transform("aliases", normalize_name).alias("_aliases"))), "facts")
    if candidates == "contained":
        pairs = fact_candidates(claim_nodes, pool, k)
    elif candidates == "all":
        pairs = similarity_candidates(claim_nodes, pool, threshold)
    else:
        raise ValueError("candidates must be 'contained' or 'all'")

    claim, fact = F.col("_claim"), F.col("_fact")
    scored = checkpoint(pairs.withColumn("_claim", normalize_name(F.col("claim_name"))), "pairs").join(
        pool.select("node_type", "fact_id", F.col("name").alias("fact_name"), F.col("ordinal").alias("fact_ordinal"), "_fact", "_aliases"),
        ["node_type", "fact_id"],
    ).withColumns({
        "_exact": claim == fact,
        "_alias": F.array_contains("_aliases", claim),
        "_ratio": levenshtein_ratio(claim, fact),
        # a phonetic match has 0.7, so above that it is not asked for
        "_sound": soundex4(F.col("claim_name")) == soundex4(F.col("fact_name")) if threshold <= 0.7 else F.lit(False),
    })
    base = F.when(F.col("_exact"), 1.0).when(F.col("_alias"), 0.95).otherwise(F.col("_ratio"))
    method = F.when(F.col("_exact"), "exact").when(F.col("_alias"), "alias").otherwise("fuzzy")
    phonetic = (base < threshold) & F.col("_sound") & (base < 0.7)
    scored = scored.select(
        F.col("node_type").alias("claim_type"), "claim_name", "fact_id", "fact_name", "fact_ordinal",
        F.col("node_type").alias("fact_type"),
        F.when(phonetic, 0.7).otherwise(base).alias("match_score"),
        F.when(phonetic, "phonetic").otherwise(method).alias("match_method"),
    ).filter(F.col("match_score") >= threshold)

    best_first = Window.partitionBy("claim_id", "claim_ordinal").orderBy(
        F.desc("match_score"), "fact_ordinal", "fact_id")
    nodes = claim_nodes.select(
        "claim_id", F.col("ordinal").alias("claim_ordinal"), F.col("name").alias("claim_name"),
        F.col("node_type").alias("claim_type"))
    if store:
        scored = checkpoint(scored, "scored")
    ranked = lambda mine: skew_join(mine, scored, ["claim_type", "claim_name"]).withColumn(
        "rank", F.row_number().over(best_first)
    ).select("claim_id", "claim_ordinal", "claim_name", "claim_type", "fact_id", "fact_name", "fact_type",
             "match_score", "match_method", "rank")
    return checkpoint_slices(lambda within: ranked(nodes.filter(within)), claim_nodes, "claim_id", "matches") if store else ranked(nodes)


def issue_rows(df: DataFrame, issue_type: str, severity, message, claim_entity=None, claim_value=None,
               fact_value=None, confidence=None) -> DataFrame:
    """Project to the issue table; plain strings become literals, columns pass through."""
    text = lambda v: (F.lit(v) if v is None or isinstance(v, str) else v).cast("string")
    return df.select(
        "claim_id", F.lit(issue_type).alias("issue_type"), text(severity).alias("severity"),
        text(message).alias("message"), text(claim_entity).alias("claim_entity"),
        text(claim_value).alias("claim_value"), text(fact_value).alias("fact_value"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence"))


def missing_entities(claim_nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """One MEDIUM issue per claim node without a match."""
    found = matches.select("claim_id", F.col("claim_ordinal").alias("ordinal")).distinct()
    rest = claim_nodes.join(found, ["claim_id", "ordinal"], "left_anti")
    return issue_rows(
        rest, "entity_not_found", "medium",
        F.concat(F.lit("No matching fact found for '"), F.col("name"), F.lit("' ("), F.col("node_type"), F.lit(")")),
        F.col("name"))


def first_matches(matches: DataFrame) -> DataFrame:
    """Per claim and name: the best match of the first node that carries the name."""
    return matches.groupBy("claim_id", "claim_name").agg(
        F.min_by(F.struct("fact_name", "match_score"), F.struct("claim_ordinal", "rank")).alias("m")
    ).select("claim_id", "claim_name", "m.fact_name", "m.match_score")


def verify_relationships(
    rels: DataFrame, matches: DataFrame, fact_edges: DataFrame, any_label: bool = False, store: bool = False
) -> DataFrame:
    """Status per claim relationship: both ends resolved and the same edge known as a fact.

    ``fact_edges``: ``source_name, relation_type, target_name`` and optionally ``source_label``;
    only Fact edges count unless ``any_label``. With ``store`` the known edges are written first, so that the
    shuffle files of their plan are gone before the relationships are joined.
    """
    if "source_label" in fact_edges.columns and not any_label:
        fact_edges = fact_edges.filter(F.col("source_label") == "Fact")
    known = fact_edges.filter(F.col("source_name").isNotNull()).groupBy(
        F.col("source_name").alias("_source"), "relation_type", F.lower("target_name").alias("_target")
    ).agg(F.count(F.lit(1)).alias("matching_facts"))
    if store:
        known = checkpoint(known, "known-edges")
    first = first_matches(matches)
    end = lambda side: first.select(
        "claim_id", F.col("claim_name").alias(f"{side}_name"), F.col("fact_name").alias(f"{side}_fact"),
        F.col("match_score").alias(f"{side}_score"))
    trimmed = rels.withColumns({"source_name": strip(F.col("source_name")), "target_name": strip(F.col("target_name"))})
    joined = (
        trimmed.join(end("source"), ["claim_id", "source_name"], "left")
        .join(end("target"), ["claim_id", "target_name"], "left")
        .withColumn("_target", F.lower("target_fact"))
        # an unresolved end gets a key of its own, so that such rows do not gather under one null key
        .withColumn("_source", F.when(F.col("target_fact").isNotNull() & F.col("source_fact").isNotNull(), F.col("source_fact")).otherwise(
            F.concat_ws("\0", F.lit(""), "claim_id", F.col("ordinal").cast("string"))))
        .join(known, ["_source", "relation_type", "_target"], "left")
    )
    resolved = F.col("source_fact").isNotNull() & F.col("target_fact").isNotNull()
    verified = resolved & F.col("matching_facts").isNotNull()
    return joined.select(
        "claim_id", "ordinal", "source_name", "relation_type", "target_name", "source_fact", "target_fact",
        F.coalesce("matching_facts", F.lit(0)).cast("bigint").alias("matching_facts"),
        resolved.alias("resolved"),
        F.when(verified, "verified").otherwise("unverifiable").alias("status"),
        F.when(verified, F.col("source_score") * F.col("target_score")).otherwise(F.lit(0.5)).alias("confidence"),
    )


def relationship_issues(validations: DataFrame) -> DataFrame:
    return issue_rows(
        validations.filter(~F.col("resolved")), "entity_not_found", "medium",
        "Cannot verify relationship - entities not found in facts")


def merge_by_priority(records: DataFrame) -> DataFrame:
    """One record per lower-cased, stripped name: best source first, then arrival ``ordinal``."""
    rank = F.lit(L.SOURCE_PRIORITY_OTHER)
    for source, priority in L.SOURCE_PRIORITY.items():
        rank = F.when(F.col("source") == source, priority).otherwise(rank)
    row = F.struct(*records.columns)
    return (
        records.groupBy(strip(F.lower("name")).alias("_key"))
        .agg(F.min_by(row, F.struct(rank.alias("p"), F.col("ordinal"))).alias("r")).select("r.*")
    )


def merge_extractions(nodes: DataFrame) -> DataFrame:
    """One node per type and lower-cased name: the first with a description, else the first.

    Relationships need no merge; all of them are kept.
    """
    empty = (F.coalesce(F.col("description"), F.lit("")) == "").cast("int")
    return (
        nodes.groupBy(F.col("node_type").alias("_t"), F.lower("name").alias("_n"))
        .agg(F.min_by(F.struct(*nodes.columns), F.struct(empty.alias("e"), F.col("ordinal"))).alias("r"))
        .select("r.*")
    )


def union_sources(*frames: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """All source results in one table, failed ones dropped, optionally only some sources."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if "error" in union.columns:
        union = union.filter(F.col("error").isNull())
    return union.filter(F.col("source").isin(sources)) if sources else union
