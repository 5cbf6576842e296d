"""Points joined to the ranges that hold them, without numbering or expanding the ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.integers import div


def interval_join(
    points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, low: str, high: str, width: int = 64
) -> DataFrame:
    """Each point with each range of its keys that has `low <= at < high`.

    Integers are cut into cells of `width`. A range is sent to every cell it touches, a point to its own, and the pair is
    an equi join on (keys, cell) with the two comparisons on top. Ranges that don't overlap, as episodes
    of a dataset don't, put at most `width` non-empty ranges in a cell, so a point is compared with no more than that,
    however many points or ranges a key has; a long range is `length / width` rows. A cell that many points meet is split
    by adaptive skew-join handling.

    Points outside all ranges, empty ranges, and rows with a null key or bound are in no pair; repeated points and
    repeated or overlapping ranges give a row each. Columns that both sides have besides the keys are refused.
    """
    clash = set(points.columns) & set(ranges.columns) - set(keys)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    # Whole division rounds towards zero: the cell around zero is twice as wide, and cells stay in order.
    cells = F.sequence(div(low, width), div(F.col(high) - 1, width))
    spread = ranges.filter(F.col(low) < F.col(high)).withColumn("__cell", F.explode(cells))
    met = points.withColumn("__cell", div(at, width)).join(spread, [*keys, "__cell"])
    return met.filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")
