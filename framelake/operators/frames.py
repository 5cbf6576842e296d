"""Frames as pixel tables (frame keys, y, x, values): layout, scaling, crops, resizing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import center_offset
from ..functions.integers import div

# Channel statistics of the usual image normalisation.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def _per_channel(channel: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (channel + 1).cast("int"))


def normalize_pixels(value: Column, channel: Column, mean=CHANNEL_MEAN, std=CHANNEL_STD) -> Column:
    return (value - _per_channel(channel, mean)) / _per_channel(channel, std)


def denormalize_pixels(value: Column, channel: Column, mean=CHANNEL_MEAN, std=CHANNEL_STD) -> Column:
    return value * _per_channel(channel, std) + _per_channel(channel, mean)


def unit_scale(pixels: DataFrame, value: str, frame_keys: Sequence[str]) -> DataFrame:
    """Divides by 255 where the pixels are integers or a frame exceeds 2.0."""
    if dict(pixels.dtypes)[value] not in ("float", "double"):
        return pixels.withColumn(value, F.col(value) / F.lit(255.0))
    peaks = pixels.groupBy(*frame_keys).agg(F.max(value).alias("__peak"))
    return (
        pixels.join(peaks, list(frame_keys))
        .withColumn(value, F.when(F.col("__peak") > 2.0, F.col(value) / 255.0).otherwise(F.col(value)))
        .drop("__peak")
    )


def to_uint8(value: Column) -> Column:
    """Float in [0, 1] to 0..255, truncated."""
    return F.floor(value * 255.0).cast("int")


def hflip(pixels: DataFrame, width: int | Column, when: Column | None = None) -> DataFrame:
    flipped = width - 1 - F.col("x")
    return pixels.withColumn("x", flipped if when is None else F.when(when, flipped).otherwise(F.col("x")))


def crop(pixels: DataFrame, top: Column, left: Column, height, width) -> DataFrame:
    """Pixels inside the box, with coordinates from its corner."""
    y, x = F.col("y") - top, F.col("x") - left
    return pixels.withColumns({"y": y, "x": x}).filter(
        (F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)
    )


def center_crop(pixels: DataFrame, size: tuple[int, int], crop_size: tuple[int, int]) -> DataFrame:
    (h, w), (th, tw) = size, crop_size
    if h < th or w < tw:
        raise ValueError("crop is larger than the frame")
    return crop(pixels, center_offset(h, th), center_offset(w, tw), th, tw)


def center_full_crop(pixels: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The largest centred square."""
    return center_crop(pixels, size, (min(size),) * 2)


def resize_bilinear(
    pixels: DataFrame,
    keys: Sequence[str],
    in_size: tuple[int, int],
    out_size: tuple[int, int],
    value: str = "value",
) -> DataFrame:
    """Bilinear resize, pixel centres aligned, edges clamped.

    An output pixel reads the two nearest rows and columns, also with weight 0; where a frame lacks one of these
    pixels, it has no output there, and a null value among them gives null.
    Every source pixel sends its weighted value to the output pixels that read it
    and one aggregation adds them; there is no neighbour join.
    """
    (h, w), (out_h, out_w) = in_size, out_size

    def reads(coordinate: str, n_in: int, n_out: int) -> Column:
        source = F.col(coordinate)
        # outputs that are clamped to the first pixel read the second one too
        low = F.when(source <= 1, F.lit(0)).otherwise(F.floor((source - 0.5) * n_out / F.lit(n_in)) - 1)
        high = F.ceil((source + 1.5) * n_out / F.lit(n_in)) + 1
        span = F.sequence(
            F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.lit(n_out - 1)).cast("long")
        )

        def tap(o: Column) -> Column:
            at = (o + 0.5) * n_in / F.lit(float(n_out)) - 0.5
            at = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(n_in - 1)))
            first = F.floor(at)
            last = F.least(first + 1, F.lit(n_in - 1))
            return F.struct(
                o.alias("to"),
                F.greatest(F.lit(1.0) - F.abs(at - source), F.lit(0.0)).alias("w"),
                (last - first + 1).alias("taps"),
                source.between(first, last).alias("read"),
            )

        return F.filter(F.transform(span, tap), lambda e: e["read"])

    taps = F.max(F.col("__y.taps") * F.col("__x.taps"))
    return (
        pixels.withColumn("__y", F.explode(reads("y", h, out_h)))
        .withColumn("__x", F.explode(reads("x", w, out_w)))
        .groupBy(*keys, F.col("__y.to").alias("y"), F.col("__x.to").alias("x"))
        .agg(
            F.when(F.count(value) == taps, F.sum(F.col(value) * F.col("__y.w") * F.col("__x.w"))).alias(value),
            (F.count(F.lit(1)) == taps).alias("__whole"),
        )
        .filter("__whole")
        .drop("__whole")
    )


def patchify(pixels: DataFrame, keys: Sequence[str], patch_size: int, width: int, value: str = "value") -> DataFrame:
    """(keys, patch, values): patches in reading order, values by row, column, channel.

    A group is one patch: patch_size squared times the channels.
    """
    p = patch_size
    patch = div("y", p) * (width // p) + div("x", p)
    place = F.struct(
        F.pmod("y", F.lit(p)).alias("dy"), F.pmod("x", F.lit(p)).alias("dx"), "channel", F.col(value).alias("v")
    )
    return (
        pixels.groupBy(*keys, patch.cast("long").alias("patch"))
        .agg(F.sort_array(F.collect_list(place)).alias("__v"))
        .select(*keys, "patch", F.col("__v.v").alias("values"))
    )
