"""Exact integer division, which a double quotient loses beyond 2^53."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a, b) -> Column:
    """Whole quotient of two integer columns (or names, or plain numbers), as a long."""

    def column(value) -> Column:
        if isinstance(value, Column):
            return value
        return F.col(value) if isinstance(value, str) else F.lit(value)

    return F.call_function("div", column(a), column(b))
