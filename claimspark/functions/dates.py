"""Partial-date and coordinate parsing. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_date(c: Column) -> Column:
    """``YYYY-MM-DD``, ``YYYY-MM`` or ``YYYY``; missing parts become 01."""
    full = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
    month = F.when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01")))
    year = F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01")))
    return F.try_to_date(F.coalesce(full, month, year), "yyyy-MM-dd")


def year_date(c: Column) -> Column:
    """First of January of a bare year 1..9999."""
    year = F.trim(c).try_cast("int")
    return F.when(year.between(1, 9999), F.make_date(F.when(year.between(1, 9999), year), F.lit(1), F.lit(1)))


def statement_date(c: Column) -> Column:
    """``+YYYY-MM-DDT..`` where month or day may be ``00``; BC years give null."""
    day = F.regexp_extract(c, r"^\+?(\d{1,4}-\d{1,2}-\d{1,2})", 1)
    fixed = F.regexp_replace(F.regexp_replace(day, r"-00-", "-01-"), r"-00$", "-01")
    return F.try_to_date(F.when(fixed != "", fixed), "y-M-d")


def iso_date(c: Column) -> Column:
    """Date part of an ISO timestamp, with or without a zone letter."""
    return F.try_to_date(
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$"), F.left(c, F.lit(10))), "yyyy-MM-dd"
    )


def leading_date(c: Column) -> Column:
    """Date in the first ten characters."""
    return F.try_to_date(F.left(c, F.lit(10)), "yyyy-M-d")


def parse_point(c: Column) -> Column:
    """``Point(lon lat)`` to struct(lat, lon); null unless both are numbers."""
    lon = F.regexp_extract(c, r"^Point\((\S+)\s+(\S+?)\)?$", 1).try_cast("double")
    lat = F.regexp_extract(c, r"^Point\((\S+)\s+(\S+?)\)?$", 2).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
