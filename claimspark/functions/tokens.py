"""Word-level functions (Column in, Column out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.lexicons import STEM_SUFFIXES, SYNONYM_GROUPS

WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokenize(c: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD2), F.lit(0))


def stem(word: Column, suffixes: Sequence[str] = tuple(STEM_SUFFIXES)) -> Column:
    """Cut one listed suffix if at least three letters stay.

    No listed suffix ends in another one, so one anchored alternation decides.
    """
    return F.regexp_replace(word, "^(.{3,})(?:" + "|".join(suffixes) + ")$", "$1")


def stemmed_tokens(c: Column, suffixes: Sequence[str] = tuple(STEM_SUFFIXES)) -> Column:
    return F.transform(tokenize(c), lambda w: stem(w, suffixes))


def expand_synonyms(terms: Column, groups: Sequence[Sequence[str]] = tuple(SYNONYM_GROUPS)) -> Column:
    """Distinct terms plus every group that one of them belongs to (group words stay unstemmed)."""
    none = F.array().cast("array<string>")
    extra = [
        F.when(F.arrays_overlap(terms, F.array(*map(F.lit, g))), F.array(*map(F.lit, g))).otherwise(none)
        for g in groups
    ]
    return F.array_distinct(F.concat(terms, *extra)) if extra else F.array_distinct(terms)


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| over two word arrays; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def jaccard_words(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def blank_split(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))


def query_coverage(query: Column, result: Column) -> Column:
    """Share of the query's distinct words that the result has; 0 for an empty side."""
    q, r = blank_split(query), blank_split(F.coalesce(result, F.lit("")))
    return F.when((F.length(F.coalesce(result, F.lit(""))) == 0) | (F.size(q) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(q, r)) / F.size(q)
    )


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True if any term is a substring; a chain of native ``contains`` that stops at the first hit."""
    found = F.lit(False)
    for term in reversed(terms):
        found = F.contains(text, F.lit(term)) | found
    return found


def count_contained(text: Column, terms: Sequence[str]) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(text, F.lit(term)).cast("int")
    return total
