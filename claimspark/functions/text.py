"""Text features, scores and wording flags: narrow projections, usable on batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.tokens import contains_any, count_contained

DATE_REGEX = "(?iU)" + "|".join(L.DATE_PATTERNS)
CITATION_REGEX = "(?U)" + L.CITATION_PATTERN


def detect_language(c: Column) -> Column:
    return F.when(count_contained(F.lower(c), L.GERMAN_INDICATORS) >= 2, "de").otherwise("en")


def input_type(c: Column) -> Column:
    return F.when(F.length(c) < 500, "claim").otherwise("article")


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def has_digits(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def vague_language(c: Column, terms=tuple(L.VAGUE_TERMS_TEXT)) -> Column:
    return contains_any(F.lower(c), terms)


def absolute_language(c: Column) -> Column:
    return contains_any(F.lower(c), L.ABSOLUTE_TERMS)


def guess_category(c: Column) -> Column:
    low = F.lower(c)
    quoted = contains_any(c, L.CATEGORY_QUOTE) | contains_any(low, L.CATEGORY_QUOTE_WORDS)
    rule = F.when(contains_any(low, L.CATEGORY_PERSON), F.when(quoted, "quote_myth").otherwise("person_myth"))
    for category, terms in L.CATEGORY_RULES:
        rule = rule.when(contains_any(low, terms), category)
    return rule.otherwise("person_myth")


def guess_era(c: Column) -> Column:
    low = F.lower(c)
    (era, terms), *rest = L.ERA_RULES
    rule = F.when(contains_any(low, terms), era)
    for era, terms in rest:
        rule = rule.when(contains_any(low, terms), era)
    return rule.otherwise("modern")


def steady(c: Column) -> Column:
    """A score without the last bits of its sum, so that thresholds see 0.7 and not 0.7000000000000001."""
    return F.round(c, 9)


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), steady(c)))


def add_if(base: Column, *steps: tuple[Column, float]) -> Column:
    for condition, amount in steps:
        base = base + F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))
    return base


def with_text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the text features and the three text scores.

    Optional input columns: ``myth_score, keyword_matches, is_known_myth, related_myths``;
    ``source_count, has_primary_source, has_academic_source, has_authority_source``;
    ``entity_score, date_score, narrative_score``. A missing one counts as absent (0 / false).
    """
    defaults = {
        "myth_score": 0.0, "keyword_matches": 0, "is_known_myth": False, "related_myths": 0,
        "source_count": 0, "has_primary_source": False, "has_academic_source": False,
        "has_authority_source": False, "entity_score": 0.0, "date_score": 0.0, "narrative_score": 0.0,
    }
    have = set(df.columns)
    df = df.withColumns(
        {k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in defaults.items()}
    )
    t = F.col(text)
    df = df.withColumn("_low", F.lower(t))
    low = F.col("_low")
    name = t.rlike(L.NAME_PATTERN)
    df = df.withColumns({
        "text_length": F.length(t),
        "word_count": F.regexp_count(t, F.lit(r"(?U)\S+")),
        "sentence_count": F.regexp_count(t, F.lit(r"[.!?]+")) + 1,
        "has_numbers": has_digits(t),
        "has_dates": t.rlike(DATE_REGEX),
        "has_names": name,
        "uses_vague_language": contains_any(low, L.VAGUE_TERMS_TEXT),
        "uses_absolute_language": contains_any(low, L.ABSOLUTE_TERMS),
        "has_citations": low.rlike(CITATION_REGEX),
        "question_marks": F.length(t) - F.length(F.translate(t, "?", "")),
        "exclamation_marks": F.length(t) - F.length(F.translate(t, "!", "")),
        "mentions_time_period": contains_any(low, L.TIME_INDICATORS),
        "mentions_location": contains_any(low, L.LOCATION_INDICATORS),
        "mentions_person": name,
        "mentions_event": contains_any(low, L.EVENT_INDICATORS),
    }).drop("_low")
    c = F.col
    return df.withColumns({
        "specificity_score": clamp(add_if(
            F.lit(0.5), (c("has_dates"), 0.15), (c("has_names"), 0.15), (c("has_numbers"), 0.1),
            (c("mentions_location"), 0.1), (c("uses_vague_language"), -0.2),
            (c("uses_absolute_language"), -0.1))),
        "credibility_score": clamp(add_if(
            F.lit(0.3), (c("has_primary_source"), 0.25), (c("has_academic_source"), 0.2),
            (c("has_authority_source"), 0.15), (c("has_citations"), 0.1)) + c("entity_score") * 0.2),
        "completeness_score": sum(
            (c(k).cast("double") for k in ("mentions_person", "mentions_event", "mentions_time_period",
                                           "mentions_location", "has_dates")), F.lit(0.0)) / 5,
    })


def rule_score_text() -> Column:
    """Rule score over the columns that ``with_text_features`` leaves behind."""
    c = F.col
    return clamp(add_if(
        F.lit(0.5), (c("is_known_myth"), -0.3), (c("has_primary_source"), 0.15),
        (c("has_academic_source"), 0.1), (c("entity_score") > 0.7, 0.15),
        (c("specificity_score") > 0.7, 0.1), (c("uses_vague_language"), -0.1),
        (c("uses_absolute_language"), -0.05), (c("narrative_score") > 0.7, -0.15),
        (c("source_count") == 0, -0.15)))


def level_text(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("unclear")


def level_claim(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.6, "medium").when(score >= 0.3, "low").otherwise("unclear")


def percent(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("bigint").cast("string"), F.lit("%"))


def _with_details(base: Column, *details: Column) -> Column:
    listed = F.concat_ws(", ", *details)
    return F.when(listed == "", base).otherwise(F.concat(base, F.lit(" ("), listed, F.lit(")")))


def interpretation_text(score: Column) -> Column:
    """One sentence per claim; fixed wording."""
    c = F.col
    base = (
        F.when(score >= 0.8, "High confidence: This claim appears well-supported by historical evidence")
        .when(score >= 0.6, "Moderate confidence: This claim has some supporting evidence but uncertainties remain")
        .when(score >= 0.4, "Low confidence: This claim has significant uncertainties or contradictions")
        .otherwise("Very low confidence: This claim appears unsupported or contradicts known facts")
    )
    return F.when(
        c("is_known_myth"),
        F.concat(F.lit("This claim matches a known historical myth. Confidence that it is TRUE: "), percent(score)),
    ).otherwise(_with_details(
        base,
        F.when(c("source_count") > 0, F.concat(c("source_count").cast("string"), F.lit(" sources cited"))),
        F.when(c("entity_score") > 0.5, F.concat(F.lit("entities "), percent(c("entity_score")), F.lit(" verified"))),
        F.when(c("uses_vague_language"), F.lit("contains vague language")),
    ))


def interpretation_graph(score: Column) -> Column:
    """One sentence per extracted claim graph; fixed wording."""
    c = F.col
    base = (
        F.when(score >= 0.8, "High confidence: The claim appears well-supported")
        .when(score >= 0.6, "Moderate confidence: Some aspects could be verified")
        .when(score >= 0.4, "Low confidence: Significant uncertainties exist")
        .otherwise("Very low confidence: Multiple issues detected")
    )
    return _with_details(
        base,
        F.when(c("num_critical_issues") > 0,
               F.concat(c("num_critical_issues").cast("string"), F.lit(" critical issues found"))),
        F.when(c("entity_match_rate") > 0.7,
               F.concat(percent(c("entity_match_rate")), F.lit(" of entities verified"))),
        F.when(c("uses_vague_language"), F.lit("vague language detected")),
    )


def credibility_overall(confidence: Column, propaganda: Column, verification: Column) -> tuple[Column, Column]:
    """Weighted score with defaults for missing parts, and its band."""
    score = steady(
        F.coalesce(confidence, F.lit(0.5)) * 0.3
        + (F.lit(1.0) - F.coalesce(propaganda, F.lit(0.0))) * 0.3
        + F.coalesce(verification, F.lit(0.5)) * 0.4
    )
    band = (
        F.when(score >= 0.7, "HIGH CREDIBILITY").when(score >= 0.5, "MODERATE CREDIBILITY")
        .when(score >= 0.3, "LOW CREDIBILITY").otherwise("VERY LOW CREDIBILITY")
    )
    return score, band
