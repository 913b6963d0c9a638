"""Feature rows and rule scores of claim graphs, vectors and top factors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.text import add_if, clamp, has_digits
from claimspark.functions.tokens import contains_any

_TYPE_COUNTS = {"num_persons": "Person", "num_events": "Event", "num_locations": "Location", "num_dates": "Date",
                "num_organizations": "Organization"}


def graph_features(claims: DataFrame, nodes: DataFrame, rels: DataFrame, today: str | None = None) -> DataFrame:
    """Structure, completeness, time and wording features per claim (one map-side aggregate per table).

    ``claims``: ``claim_id`` and optionally ``source_text``. ``today`` fixes the "future" test.
    """
    now = F.to_date(F.lit(today)) if today else F.current_date()
    life = F.col("node_type") == "Person"
    event = F.col("node_type") == "Event"
    first = F.when(life, F.col("birth_date")).when(event, F.col("start_date"))
    second = F.when(life, F.col("death_date")).when(event, F.col("end_date"))
    n = F.count(F.lit(1))
    per_nodes = nodes.groupBy("claim_id").agg(
        n.alias("num_nodes"),
        *[F.count_if(F.col("node_type") == t).alias(c) for c, t in _TYPE_COUNTS.items()],
        (F.count_if(first.isNotNull() | second.isNotNull()) / n).alias("nodes_with_dates"),
        F.avg(F.length(F.coalesce("description", F.lit("")))).alias("avg_description_length"),
        F.avg(F.length("name")).alias("avg_entity_name_length"),
        F.min(F.least(first, second)).alias("_first"), F.max(F.greatest(first, second)).alias("_last"),
    )
    per_rels = rels.groupBy("claim_id").agg(F.count(F.lit(1)).alias("num_relationships"))
    text = F.col("source_text") if "source_text" in claims.columns else F.lit(None).cast("string")
    base = claims.select(
        "claim_id",
        F.coalesce(contains_any(F.lower(text), L.VAGUE_TERMS_GRAPH), F.lit(False)).alias("uses_vague_language"),
        F.coalesce(has_digits(text), F.lit(False)).alias("has_specific_numbers"))
    joined = base.join(per_nodes, "claim_id", "left").join(per_rels, "claim_id", "left")
    counts = ["num_nodes", "num_relationships", *_TYPE_COUNTS]
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts} | {
        c: F.coalesce(c, F.lit(0.0)) for c in ("nodes_with_dates", "avg_description_length", "avg_entity_name_length")})
    c = F.col
    joined = joined.withColumns({
        "relationships_per_node": F.when(c("num_nodes") > 0, c("num_relationships") / c("num_nodes")).otherwise(0.0),
        "date_span_days": F.datediff("_last", "_first"),
        "dates_in_future": F.coalesce(c("_last") > now, F.lit(False)),
        "dates_very_old": F.lit(False),  # years before 1 do not exist in a date column
        "has_source_citations": F.lit(False),
    }).drop("_first", "_last")
    return with_graph_scores(joined)


def with_graph_scores(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "completeness_score": (F.least(F.lit(1.0), c("num_nodes") / 5) + c("nodes_with_dates")
                               + F.least(F.lit(1.0), c("relationships_per_node"))
                               + F.least(F.lit(1.0), c("avg_description_length") / 100)) / 4,
        "specificity_score": F.least(F.lit(1.0), add_if(
            F.lit(0.5), (c("has_specific_numbers"), 0.2), (~c("uses_vague_language"), 0.2), (c("num_dates") > 0, 0.1))),
    })


def enrich_features(features: DataFrame, matches: DataFrame, issues: DataFrame) -> DataFrame:
    """Append match rate, mean match score, issue counts and the consistency score."""
    m = matches.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("match_score").alias("avg_entity_match_score"))
    i = issues.groupBy("claim_id").agg(
        F.count_if(F.col("severity") == "critical").alias("num_critical_issues"),
        F.count_if(F.col("severity") == "high").alias("num_high_issues"),
        F.count_if(F.contains(F.lower("issue_type"), F.lit("chronolog"))).alias("num_chronological_issues"))
    df = features.join(m, "claim_id", "left").join(i, "claim_id", "left")
    c = F.col
    df = df.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("num_critical_issues", "num_high_issues", "num_chronological_issues")} | {
        "entity_match_rate": F.coalesce(c("_n"), F.lit(0)) / F.greatest(F.lit(1), c("num_nodes")),
        "avg_entity_match_score": F.coalesce("avg_entity_match_score", F.lit(0.0))}).drop("_n")
    return df.withColumn("consistency_score", consistency_score())


def consistency_score() -> Column:
    c = F.col
    raw = 1.0 - c("num_critical_issues") * 0.3 - c("num_high_issues") * 0.15 - c("num_chronological_issues") * 0.1
    return clamp(F.when(c("entity_match_rate") > 0, raw * 0.5 + c("avg_entity_match_score") * 0.5).otherwise(raw))


def rule_contributions_graph() -> dict[str, Column]:
    """Contribution of each rule; null when a rule does not apply."""
    c = F.col
    return {
        "critical_issues": F.when(c("num_critical_issues") > 0, -F.least(F.lit(0.4), c("num_critical_issues") * 0.2)),
        "high_issues": F.when(c("num_high_issues") > 0, -F.least(F.lit(0.2), c("num_high_issues") * 0.1)),
        "entity_match_rate": F.when(c("entity_match_rate") > 0, c("entity_match_rate") * 0.3),
        "completeness": c("completeness_score") * 0.15,
        "specificity": c("specificity_score") * 0.1,
        "consistency": (c("consistency_score") - 0.5) * 0.2,
        "vague_language": F.when(c("uses_vague_language"), F.lit(-0.1)),
        "future_dates": F.when(c("dates_in_future"), F.lit(-0.3)),
    }


def rule_score_graph() -> Column:
    total = F.lit(0.5)
    for part in rule_contributions_graph().values():
        total = total + F.coalesce(part, F.lit(0.0))
    return clamp(total)


def contributions_map() -> Column:
    pairs = [x for k, v in rule_contributions_graph().items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


# ---- vectors -----------------------------------------------------------------------------------
def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _scaled(columns: list[tuple[str, float]]) -> dict[str, Column]:
    return {f"v_{name}": _number(name) / scale for name, scale in columns}


# Feature order and scale of the two vectors.
GRAPH_VECTOR = [
    ("num_nodes", 1), ("num_relationships", 1), ("num_persons", 1), ("num_events", 1), ("num_locations", 1),
    ("num_dates", 1), ("num_organizations", 1), ("nodes_with_dates", 1), ("relationships_per_node", 1),
    ("avg_description_length", 100), ("has_source_citations", 1), ("date_span_days", 365), ("dates_in_future", 1),
    ("dates_very_old", 1), ("avg_entity_name_length", 20), ("uses_vague_language", 1), ("has_specific_numbers", 1),
    ("entity_match_rate", 1), ("avg_entity_match_score", 1), ("num_critical_issues", 1), ("num_high_issues", 1),
    ("num_chronological_issues", 1), ("completeness_score", 1), ("specificity_score", 1), ("consistency_score", 1),
]
TEXT_VECTOR = [
    ("text_length", 1000), ("word_count", 100), ("sentence_count", 10), ("has_numbers", 1), ("has_dates", 1),
    ("has_names", 1), ("uses_vague_language", 1), ("uses_absolute_language", 1), ("has_citations", 1),
    ("question_marks", 5), ("mentions_time_period", 1), ("mentions_location", 1), ("mentions_person", 1),
    ("mentions_event", 1), ("myth_score", 1), ("keyword_matches", 10), ("is_known_myth", 1), ("related_myths", 5),
    ("source_count", 5), ("has_primary_source", 1), ("has_academic_source", 1), ("has_authority_source", 1),
    ("entity_score", 1), ("date_score", 1), ("narrative_score", 1), ("specificity_score", 1),
    ("credibility_score", 1), ("completeness_score", 1),
]


def with_vector(df: DataFrame, spec: list[tuple[str, float]], output: str = "features") -> DataFrame:
    """Append the feature vector; a column the table lacks counts as 0."""
    missing = {name: F.lit(0.0) for name, _ in spec if name not in df.columns}
    parts = _scaled(spec)
    wide = df.withColumns(missing).withColumns(parts) if missing else df.withColumns(parts)
    packed = VectorAssembler(inputCols=list(parts), outputCol=output).transform(wide)
    return packed.drop(*parts, *missing)


# ---- explanations ------------------------------------------------------------------------------
def _factor(condition: Column, name: str, impact: str, importance, order: int) -> Column:
    weight = importance if isinstance(importance, Column) else F.lit(float(importance))
    return F.when(condition, F.struct((-weight.cast("double")).alias("neg"), F.lit(order).alias("pos"),
                                      F.lit(name).alias("factor"), F.lit(impact).alias("impact")))


def _best(factors: list[Column], k: int) -> Column:
    some = F.array_sort(F.filter(F.array(*factors), lambda f: f.isNotNull()))
    return F.transform(F.slice(some, 1, k), lambda f: F.struct(f["factor"].alias("factor"), f["impact"].alias("impact"),
                                                               (-f["neg"]).alias("importance")))


def top_factors_text(k: int = 5) -> Column:
    c = F.col
    return _best([
        _factor(c("is_known_myth"), "known_myth", "negative", 0.9, 0),
        _factor(c("has_primary_source"), "primary_source", "positive", 0.8, 1),
        _factor(c("has_academic_source"), "academic_source", "positive", 0.7, 2),
        _factor(c("uses_vague_language"), "vague_language", "negative", 0.5, 3),
        _factor(c("entity_score") > 0.7, "verified_entities", "positive", c("entity_score"), 4),
        _factor(c("narrative_score") > 0.5, "propaganda_pattern", "negative", c("narrative_score"), 5),
        _factor(c("specificity_score") > 0.7, "high_specificity", "positive", 0.6, 6),
    ], k)


def top_factors_graph(k: int = 5) -> Column:
    c = F.col
    return _best([
        _factor(c("num_critical_issues") > 0, "critical_issues", "negative", 0.9, 0),
        _factor(c("entity_match_rate") > 0.5, "entity_match_rate", "positive", c("entity_match_rate"), 1),
        _factor(c("dates_in_future"), "dates_in_future", "negative", 0.8, 2),
        _factor(c("completeness_score") > 0.7, "completeness_score", "positive", c("completeness_score") * 0.5, 3),
    ], k)
