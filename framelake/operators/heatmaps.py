"""Heat-map values scaled to [0, 1] and laid out as atlases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colors import DIVERGING, SEQUENTIAL, color_ramp
from ..functions.geometry import atlas_position
from ..functions.vectors import let

FLAT = 1e-12


def _clip(t: Column) -> Column:
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def scale_relative(values: Column, kind: str) -> Column:
    """Scaled row of one kind: affinity from [-1, 1], difference by the row's largest
    magnitude, target and prediction by the row's range (0.5 when flat)."""
    if kind == "affinity":
        return F.transform(values, lambda v: _clip((v + 1.0) / 2.0))
    if kind == "difference":
        return let(
            F.array_max(F.transform(values, F.abs)),
            lambda peak: F.transform(
                values, lambda v: _clip((F.when(peak > FLAT, v / peak).otherwise(0.0) + 1.0) / 2.0)
            ),
        )
    extent = F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))

    def scaled(e: Column) -> Column:
        span = e["high"] - e["low"]
        return F.transform(values, lambda v: _clip(F.when(span > FLAT, (v - e["low"]) / span).otherwise(0.5)))

    return let(extent, scaled)


def scale_fixed(values: Column, kind: str, probability_max: float, difference_abs_max: float) -> Column:
    """The same with fixed limits, so frames are comparable."""
    if kind == "difference":
        return F.transform(values, lambda v: _clip((v / difference_abs_max + 1.0) / 2.0))
    return F.transform(values, lambda v: _clip(v / probability_max))


def ramp_of(kind: str):
    return DIVERGING if kind in ("affinity", "difference") else SEQUENTIAL


def atlas_tiles(rows: DataFrame, scaled: str, grid: tuple[int, int], kind: str | None = None) -> DataFrame:
    """(video, frame, tile_y, tile_x, tile): one atlas tile per source patch.

    A tile holds its target patches in reading order, as values or, with `kind`, as
    colours; `atlas_position` gives the place of a single pixel.
    """
    y, x = atlas_position(F.col("patch"), F.lit(0), *grid)
    tile = F.col(scaled)
    if kind is not None:
        tile = F.transform(tile, lambda t: color_ramp(t, ramp_of(kind)))
    return rows.select("video", "frame", y.alias("tile_y"), x.alias("tile_x"), tile.alias("tile"))
