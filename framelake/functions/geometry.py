"""Integer geometry of images, patches and atlases."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .integers import div


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def patch_grid(n_patches, height, width) -> Column:
    """struct(grid_h, grid_w) for a patch count and image size; square if the ratio does not fit."""
    n, h, w = _col(n_patches), _col(height), _col(width)
    ratio = w.cast("double") / h
    rows = F.floor(F.sqrt(n / ratio)).cast("long")
    cols = F.floor(F.sqrt(n * ratio)).cast("long")
    side = F.floor(F.sqrt(n.cast("double"))).cast("long")
    pair = lambda a, b: F.struct(a.alias("grid_h"), b.alias("grid_w"))
    return (
        F.when(rows * cols == n, pair(rows, cols))
        .when(side * side == n, pair(side, side))
        .otherwise(
            F.raise_error(F.concat(F.lit("no patch grid for "), n.cast("string"), F.lit(" patches")))
        )
    )


def short_side_size(height, width, size: int) -> Column:
    """struct(new_h, new_w): the short side becomes `size`, the long one keeps the ratio."""
    h, w = _col(height), _col(width)
    tall = F.floor(h.cast("double") / w * size).cast("long")
    wide = F.floor(w.cast("double") / h * size).cast("long")
    fixed = F.lit(size).cast("long")
    return F.struct(
        F.when(w < h, tall).otherwise(fixed).alias("new_h"),
        F.when(w < h, fixed).otherwise(wide).alias("new_w"),
    )


def center_offset(full, crop) -> Column:
    """Top/left offset of a centred crop, halves rounded to even."""
    return F.bround((_col(full) - _col(crop)) / F.lit(2.0)).cast("long")


def nearest_source(dst, n_in, n_out) -> Column:
    """Source coordinate that a nearest (pixel-centre) resize reads for output `dst`."""
    pos = F.floor((_col(dst) + F.lit(0.5)) * _col(n_in) / _col(n_out)).cast("long")
    return F.least(pos, (_col(n_in) - 1).cast("long"))


def boundary_dilation(height: int, width: int, ratio: float = 0.02) -> int:
    """Half width of the erosion box for an image size."""
    return max(1, round(ratio * math.hypot(height, width)))


def atlas_position(source, target, grid_h: int, grid_w: int) -> tuple[Column, Column]:
    """(atlas_y, atlas_x) of one (source patch, target patch) value."""
    s, t = _col(source), _col(target)
    row = div(s, grid_w) * grid_h + div(t, grid_w)
    column = F.pmod(s, F.lit(grid_w)) * grid_w + F.pmod(t, F.lit(grid_w))
    return row.cast("long"), column.cast("long")
