"""Generated images: random pixels, or squares with instance masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform


def _pixels(images: DataFrame, height: int, width: int) -> DataFrame:
    axis = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return images.withColumn("y", F.explode(axis(height))).withColumn("x", F.explode(axis(width)))


def random_pixels(images: DataFrame, key: str, height: int, width: int, seed: int = 0) -> DataFrame:
    """(key, y, x, value) with values 0..254."""
    pixels = _pixels(images.select(key), height, width)
    return pixels.withColumn("value", F.floor(hash_uniform(seed, key, "y", "x") * 255).cast("int"))


def square_images(
    images: DataFrame, key: str, height: int, width: int, n_objects: int = 3, seed: int = 0, shift_x: int = 0
) -> DataFrame:
    """The columns of `images` with y, x, label and value (255, or 0 inside a square).

    A later square covers an earlier one. Squares are drawn once per image, before
    the pixels are made.
    """
    limit = int(0.3 * (height + width) / 2)
    drawn = images.withColumns(
        {
            f"__{name}{i}": F.floor(hash_uniform(f"{seed}-{i}", key, offset=word) * n).cast("long")
            for i in range(n_objects)
            for word, (name, n) in enumerate((("x", width), ("y", height), ("s", limit)))
        }
    )
    pixels = _pixels(drawn, height, width)

    def inside(i: int):
        dx, dy = F.col("x") - F.col(f"__x{i}") - shift_x, F.col("y") - F.col(f"__y{i}")
        size = F.col(f"__s{i}")
        return (dx >= 0) & (dx < size) & (dy >= 0) & (dy < size)

    label = F.greatest(F.lit(0), *[F.when(inside(i), F.lit(i + 1)).otherwise(F.lit(0)) for i in range(n_objects)])
    labelled = pixels.withColumn("label", label.cast("long"))
    scratch = [f"__{name}{i}" for i in range(n_objects) for name in ("x", "y", "s")]
    return labelled.withColumn("value", F.when(F.col("label") > 0, 0).otherwise(255)).drop(*scratch)
