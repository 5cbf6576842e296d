"""Query registry and the small SQL building blocks of the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def r6(value: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.when(F.abs(value) < 5e-7, F.lit(0.0)).otherwise(F.round(value, 6))


def s6(expression: str) -> str:
    """`r6` in SQL."""
    return f"(CASE WHEN abs({expression}) < 5e-7 THEN CAST(0 AS DOUBLE) ELSE round({expression}, 6) END)"


def joined(array: Column | str) -> Column:
    column = F.col(array) if isinstance(array, str) else array
    return F.array_join(column.cast("array<string>"), ",")


def micros(array: Column | str) -> Column:
    """Array of doubles as text, in millionths."""
    column = F.col(array) if isinstance(array, str) else array
    return joined(F.transform(column, lambda x: F.round(x * 1e6).cast("long")))


def smicros(expression: str) -> str:
    """`micros` in SQL."""
    return f"array_to_string(list_transform({expression}, lambda q: CAST(round(q * 1e6) AS BIGINT)), ',')"
