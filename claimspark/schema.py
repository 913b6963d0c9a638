"""Table schemas and row validation with quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.names import strip

NODES = (
    "claim_id string, ordinal int, node_type string, name string, aliases array<string>, description string, "
    "source_label string, confidence double, birth_date date, death_date date, nationality string, "
    "occupation array<string>, start_date date, end_date date, event_type string, location_type string, "
    "coordinates struct<lat:double,lon:double>, parent_location string, date_value date, precision string, "
    "calendar_system string, org_type string, founded_date date, dissolved_date date, headquarters string"
)
RELATIONSHIPS = (
    "claim_id string, ordinal int, source_name string, source_type string, relation_type string, target_name string, "
    "target_type string, source_label string, confidence double, properties map<string,string>"
)
FACTS = (
    "id string, claim string, is_true boolean, explanation string, source string, source_url string, claim_type string, "
    "entities array<string>, confidence double, created_at timestamp"
)
MYTHS = (
    "id string, ordinal bigint, claim string, claim_en string, category string, era string, regions array<string>, "
    "status string, truth string, truth_en string, origin struct<source:string,date:string,reason:string>, "
    "sources array<struct<type:string,title:string,author:string,year:int,url:string>>, keywords array<string>, "
    "debunked_by array<string>, related_myths array<string>, popularity int"
)
NARRATIVES = (
    "id string, name string, name_en string, description string, typical_claims array<string>, keywords array<string>, "
    "examples array<string>, purpose string"
)
AUTHORITY_RECORDS = (
    "source string, authority_id string, name string, name_variants array<string>, entity_type string, birth_date date, "
    "death_date date, birth_raw string, death_raw string, description string, quality string, ordinal bigint"
)
CANDIDATES = (
    "id string, claim string, truth string, category string, era string, status string, source_text string, "
    "extraction_date timestamp, confidence_score double, keywords array<string>, review_status string, "
    "reviewer_notes string, reviewed_at timestamp"
)
SOURCE_RESULT = (
    "source_name string, source_type string, tier string, found boolean, title string, url string, extract string, "
    "relevance_score double, reliability_score double, claim_review string, rating string, error string"
)
VERIFICATIONS = (
    "query string, verified boolean, confidence double, sources_checked int, sources_found int, "
    f"highest_tier_found string, results array<struct<{SOURCE_RESULT.replace(' ', ':').replace(',:', ', ')}>>, "
    "fact_check_rating string, summary string, recommendation string, cached boolean, timestamp timestamp"
)


def _reasons(checks: dict[str, Column]) -> Column:
    """Names of the failed checks; a check that yields null counts as passed."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]),
                    lambda r: r.isNotNull())


def _split(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reject_reasons", _reasons(checks))
    return marked.filter(F.size("reject_reasons") == 0).drop("reject_reasons"), marked.filter(F.size("reject_reasons") > 0)


def validate_nodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid nodes, and rejected ones with ``reject_reasons``."""
    c, have = F.col, set(df.columns)
    checks = {
        "name": c("name").isNull() | ~F.length("name").between(1, 500),
        "node_type": c("node_type").isNull() | ~c("node_type").isin(L.NODE_TYPES),
    }
    if "description" in have:
        checks["description"] = F.length("description") > 2000
    if "confidence" in have:
        checks["confidence"] = ~c("confidence").between(0.0, 1.0)
    if "source_label" in have:
        checks["source_label"] = ~c("source_label").isin(L.SOURCE_LABELS)
    if "nationality" in have:
        checks["nationality"] = F.length("nationality") > 100
    if {"start_date", "end_date"} <= have:
        checks["date_range"] = (c("node_type") == "Event") & (c("end_date") < c("start_date"))
    if "date_value" in have:
        checks["date_value"] = (c("node_type") == "Date") & c("date_value").isNull()
    if "precision" in have:
        checks["precision"] = (c("node_type") == "Date") & ~c("precision").isin(L.DATE_PRECISIONS)
    return _split(df, checks)


def validate_rels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid relationships with stripped end names, and rejected ones with ``reject_reasons``."""
    df = df.withColumns({"source_name": strip(F.col("source_name")), "target_name": strip(F.col("target_name"))})
    c, have = F.col, set(df.columns)
    checks = {
        "source_name": c("source_name").isNull(),
        "target_name": c("target_name").isNull(),
        "relation_type": c("relation_type").isNull() | ~c("relation_type").isin(L.RELATION_TYPES),
    }
    for end in ("source_type", "target_type"):
        if end in have:
            checks[end] = c(end).isNull() | ~c(end).isin(L.NODE_TYPES)
    if "confidence" in have:
        checks["confidence"] = ~c("confidence").between(0.0, 1.0)
    if "source_label" in have:
        checks["source_label"] = ~c("source_label").isin(L.SOURCE_LABELS)
    return _split(df, checks)
