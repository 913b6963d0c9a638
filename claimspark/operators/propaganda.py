"""Rhetoric patterns and narratives per text: one narrow projection, no shuffle, stream-safe."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.text import steady
from claimspark.functions.tokens import contains_any, count_contained

# Unicode classes and word edges; "." stops at line feeds only.
_FLAGS = "(?dU)"


def literal_anchors(regex: str) -> list[str]:
    """Substrings of which every match of the pattern holds at least one; empty if none can be named.

    Reads the leading group of alternatives and takes the longest plain run of each.
    """
    if not regex.startswith(r"\b("):
        return []
    depth, end, cuts = 0, 0, [3]
    for i in range(2, len(regex)):
        if regex[i - 1] == "\\":
            continue
        depth += (regex[i] == "(") - (regex[i] == ")")
        if regex[i] == "|" and depth == 1:
            cuts.append(i + 1)
        if depth == 0:
            end = i
            break
    anchors = []
    for start, stop in zip(cuts, [c - 1 for c in cuts[1:]] + [end]):
        bare = re.sub(r"\[[^\]]*\]", "\0", regex[start:stop])
        while "(" in bare and (inner := re.sub(r"\([^()]*\)", "\0", bare)) != bare:
            bare = inner
        bare = re.sub(r".?[?*+]|.?\{[^}]*\}|\.|\\[A-Za-z]|[{}^$()]", "\0", bare).replace("\\", "")
        run = max(bare.split("\0"), key=len)
        if len(run) < 2:
            return []
        anchors.append(run.lower())
    return anchors


def two_parts(regex: str) -> tuple[str, str, bool] | None:
    """(first, second, wanted) of a pattern "first.*second" or "first(?!.*second)", else None."""
    if regex.endswith(")") and "(?!.*" in regex:
        first, second = regex[:-1].split("(?!.*", 1)
        return first, second, False
    cut = regex.rfind(r"\b.*\b(")
    return (regex[:cut + 2], regex[cut + 4:], True) if cut > 0 else None


def _flags(regex: str) -> str:
    return _FLAGS[:-1] + "iu)" if re.search(r"(?<!\\)[A-Z]", regex) else _FLAGS


def _lines(low: Column, regex: str) -> tuple[Column, str]:
    """The parts of a text in which the pattern can match, and the pattern to look for in them.

    A pattern of two parts that is tried at every place of a line is quadratic in its length. Nothing behind the
    last second part of a line can belong to a match, and nothing before it to a match that must not be followed by
    it, so lines are cut there first; then the first try at a first part succeeds.
    """
    parts, flags = two_parts(regex), _flags(regex)
    if not parts:
        return F.array(low), flags + regex
    first, second, wanted = parts
    anchors = literal_anchors(first), literal_anchors(second)
    lines = F.filter(F.split(low, "\n"), lambda x: contains_any(x, anchors[0])) if anchors[0] else F.split(low, "\n")
    upto = flags + "^.*" + second
    if not wanted:
        return F.transform(lines, lambda x: F.regexp_replace(x, upto, "")), flags + first
    if anchors[1]:
        lines = F.filter(lines, lambda x: contains_any(x, anchors[1]))
    return F.transform(lines, lambda x: F.regexp_extract(x, upto, 0)), flags + regex


def _count(low: Column, regex: str) -> Column:
    """Occurrences of a pattern; texts without any of its anchor words skip the regex."""
    lines, pattern = _lines(low, regex)
    n = F.aggregate(F.transform(lines, lambda x: F.regexp_count(x, F.lit(pattern))), F.lit(0), lambda a, x: a + x) if two_parts(regex) else F.regexp_count(low, F.lit(pattern))
    anchors = literal_anchors(regex)
    return F.when(contains_any(low, anchors), n).otherwise(F.lit(0)) if anchors else n


def _first_match(low: Column, regex: str) -> Column:
    """The words of the first group of the first match, null without one."""
    lines, pattern = _lines(low, regex)
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda m: m != "")
    anchors = literal_anchors(regex)
    return F.when(contains_any(low, anchors), F.get(found, F.lit(0))) if anchors else F.get(found, F.lit(0))


def _confidence(n: Column, weight: float) -> Column:
    return F.when(n > 0, F.least(F.lit(1.0), F.round(F.least(F.lit(1.0), n * 0.1 + 0.5) * weight, 2)))


def pattern_hits(low: Column, patterns=tuple(L.TECHNIQUE_PATTERNS)) -> Column:
    """Array of ``(technique, pattern_no, n, confidence)`` for every pattern that occurs in the text."""
    counts = F.array(*[
        F.struct(F.lit(technique).alias("technique"), F.lit(i).alias("pattern_no"),
                 _count(low, regex).alias("n"), F.lit(weight).alias("weight"))
        for technique, weight, _, regexes in patterns for i, regex in enumerate(regexes)])
    return F.transform(F.filter(counts, lambda h: h["n"] > 0), lambda h: F.struct(
        h["technique"].alias("technique"), h["pattern_no"].alias("pattern_no"), h["n"].alias("n"),
        _confidence(h["n"], h["weight"]).alias("confidence")))


def best_per_technique(low: Column, patterns=tuple(L.TECHNIQUE_PATTERNS)) -> Column:
    """Array of ``(technique, confidence)``: the best of its patterns for every technique found."""
    none = F.lit(None).cast("double")
    entries = []
    for technique, weight, _, regexes in patterns:
        best = F.greatest(none, *[_confidence(_count(low, r), weight) for r in regexes])
        entries.append(F.struct(F.lit(technique).alias("technique"), best.alias("confidence")))
    return F.filter(F.array(*entries), lambda e: e["confidence"].isNotNull())


def evidence(low: Column, patterns=tuple(L.TECHNIQUE_PATTERNS)) -> Column:
    """Array of ``(technique, confidence, evidence, explanation)``: the best pattern of every technique found, the first of
    equals, with the words it matched."""
    entries = []
    for technique, weight, explanation, regexes in patterns:
        hits = F.array(*[F.struct(_confidence(_count(low, r), weight).alias("confidence"), F.lit(-i).alias("order"), _first_match(low, r).alias("text"))
                         for i, r in enumerate(regexes)])
        best = F.array_max(F.filter(hits, lambda h: h["confidence"].isNotNull()))
        entries.append(F.struct(F.lit(technique).alias("technique"), best["confidence"].alias("confidence"),
                                F.concat(F.lit("Found pattern: "), best["text"]).alias("evidence"), F.lit(explanation).alias("explanation")))
    return F.filter(F.array(*entries), lambda e: e["confidence"].isNotNull())


def recommendation(is_propaganda: Column) -> Column:
    # fixed values: the two sentences
    return F.when(is_propaganda, "This content should be fact-checked against authoritative sources. Be cautious of emotional manipulation and verify all claims independently."
                  ).otherwise("Standard fact-checking procedures apply.")


def narrative_hits(low: Column, narratives=None, minimum: int = 2) -> Column:
    """Ids of narratives with at least ``minimum`` keywords in the text."""
    narratives = narratives or L.NARRATIVE_KEYWORDS
    flags = F.array(*[F.when(count_contained(low, kw) >= minimum, F.lit(n)) for n, kw in narratives.items()])
    return F.filter(flags, lambda n: n.isNotNull())


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.4, "medium").otherwise("low")


def with_propaganda(texts: DataFrame, text: str = "text", patterns=tuple(L.TECHNIQUE_PATTERNS), narratives=None) -> DataFrame:
    """Append techniques, narratives, ``propaganda_score``, ``is_propaganda`` and ``risk_level``."""
    low = texts.withColumn("_low", F.lower(text))
    found = low.withColumns({
        "techniques": best_per_technique(F.col("_low"), patterns),
        "narratives": narrative_hits(F.col("_low"), narratives),
    }).drop("_low")
    n, m = F.size("techniques"), F.size("narratives")
    mean = F.aggregate("techniques", F.lit(0.0), lambda acc, t: acc + t["confidence"]) / n
    raw = F.when(n > 0, F.least(F.lit(1.0), mean + F.least(F.lit(0.3), n * 0.1) + F.least(F.lit(0.2), m * 0.1))).otherwise(0.0)
    scored = found.withColumn("_raw", steady(raw))
    return scored.withColumns({
        "propaganda_score": F.round("_raw", 3),
        "is_propaganda": F.col("_raw") >= 0.5,
        "risk_level": risk_level(F.col("_raw")),
    }).drop("_raw")


def propaganda_summary() -> Column:
    """Fixed wording over the columns of ``with_propaganda``."""
    named = F.array_join(F.slice(F.transform("techniques", lambda t: t["technique"]), 1, 3), ", ")
    flagged = F.concat(F.lit("This text shows signs of propaganda ("), F.col("risk_level"),
                       F.lit(" risk). Detected techniques: "), named, F.lit("."))
    story = F.when(F.size("narratives") > 0, F.concat(
        F.lit(" Matches known narrative patterns: "), F.element_at("narratives", 1), F.lit("."))).otherwise("")
    return F.when(F.col("is_propaganda"), F.concat(flagged, story)).otherwise("No significant propaganda patterns detected.")


def technique_title(technique: Column) -> Column:
    return F.initcap(F.replace(technique, F.lit("_"), F.lit(" ")))
