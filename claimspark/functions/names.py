"""Name and identifier functions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Consonant classes of the phonetic code, one digit per letter.
SOUNDEX_LETTERS = "BFPVCGJKQSXZDTLMNR"
SOUNDEX_DIGITS = "111122222222334556"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column) -> Column:
    """Lower-case, strip, drop everything but word characters and blanks, collapse blanks.

    Names of ASCII words with single blanks, which are most, are told by one cheap pattern and stay as they are.
    """
    low = F.lower(c)
    bare = F.regexp_replace(strip(low), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.when(low.rlike(r"[^a-z0-9_ ]|^ | \z|  "), F.regexp_replace(bare, r"(?U)\s+", " ")).otherwise(low)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 when either side is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longest
    )


def soundex4(c: Column) -> Column:
    """Phonetic code in which vowels, H, W and blanks all end a run of equal digits."""
    up = F.upper(c)
    digits = F.translate(
        F.regexp_replace(up, f"[^{SOUNDEX_LETTERS}]", "0"), SOUNDEX_LETTERS, SOUNDEX_DIGITS
    )
    runs = F.regexp_replace(digits, r"(.)\1+", "$1")
    tail = F.translate(F.substring(runs, 2, 1_000_000), "0", "")
    return F.when(F.length(c) == 0, F.lit("")).otherwise(
        F.rpad(F.concat(F.left(up, F.lit(1)), F.left(tail, F.lit(3))), 4, "0")
    )


def text_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` plus the first 8 hex digits of md5 over the parts joined by ``_``."""
    return F.concat(F.lit(prefix), F.left(F.md5(F.concat_ws("_", *parts)), F.lit(8)))
