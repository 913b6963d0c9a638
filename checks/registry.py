"""Name, Spark function and SQL of every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.inputs import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def steady_rounding(sql: str) -> str:
    """Let every ``round(x, 3)`` and ``round(x, 6)`` round decimals half up.

    Sums of doubles differ in their last bits from run to run; both engines therefore round to nine
    digits first and then cut on the decimal value.
    """
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        digits = sql[comma + 1:k - 1].strip() if comma > 0 else ""
        inner = steady_rounding(sql[j + 6:comma if comma > 0 else k - 1])
        if digits in ("3", "6"):
            out.append(f"{sql[i:j]}CAST(round(CAST(round({inner}, 9) AS DECIMAL(28, 9)), {digits}) AS DOUBLE)")
        else:
            out.append(sql[i:j] + "round(" + inner + (sql[comma:k] if comma > 0 else ")"))
        i = k
    return "".join(out) + sql[i:]


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; ``needs`` names the derived inputs its SQL reads."""
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = steady_rounding(with_ctes(needs, sql) if needs else sql)
        return fn

    return add
