"""Annotation tables: filters, loading by id, enrichment and run-length masks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.integers import div
from .numbering import dense_index, int_bucket


def annotations_filter(
    annotations: DataFrame,
    video_ids: Sequence[int] = (),
    category_ids: Sequence = (),
    area_range: Sequence[float] = (),
    iscrowd: bool | None = None,
) -> DataFrame:
    """Rows that satisfy every given condition; an empty condition keeps all. The range is open."""
    out = annotations
    if len(video_ids):
        out = out.filter(F.col("video_id").isin(list(video_ids)))
    if len(category_ids):
        out = out.filter(F.col("category_id").isin(list(category_ids)))
    if len(area_range):
        out = out.filter((F.col("avg_area") > area_range[0]) & (F.col("avg_area") < area_range[1]))
    if iscrowd is not None:
        out = out.filter(F.col("iscrowd").cast("boolean") == F.lit(bool(iscrowd)))
    return out


def categories_filter(
    categories: DataFrame,
    names: Sequence[str] = (),
    supercategories: Sequence[str] = (),
    ids: Sequence = (),
) -> DataFrame:
    out = categories
    for column, wanted in (("name", names), ("supercategory", supercategories), ("id", ids)):
        if len(wanted):
            out = out.filter(F.col(column).isin(list(wanted)))
    return out


def videos_with_all_categories(
    annotations: DataFrame, category_ids: Sequence, video_ids: Sequence[int] = ()
) -> DataFrame:
    """Videos that hold every category, optionally among the given ids.

    One flag per category is folded with max, so a video with very many
    annotations is reduced before the shuffle.
    """
    if len(video_ids):
        annotations = annotations.filter(F.col("video_id").isin(list(video_ids)))
    if not len(category_ids):
        return annotations.select("video_id").distinct()
    flags = [F.max((F.col("category_id") == c).cast("int")).alias(f"__has{i}") for i, c in enumerate(category_ids)]
    present = annotations.filter(F.col("category_id").isin(list(category_ids))).groupBy("video_id").agg(*flags)
    for i in range(len(category_ids)):
        present = present.filter(F.col(f"__has{i}") == 1)
    return present.select("video_id")


def pair_frames_with_masks(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Frame files joined to the mask file with the same video and stem."""
    return frames.join(masks.withColumnRenamed("path", "mask_path"), ["video", "stem"])


def expand_video_annotations(videos: DataFrame, annotations: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, frame_index, instance, annotation_id, category_id, area, is_empty).

    Every annotation of a video gets one row per frame of the video; a frame
    without a segment has an empty mask, and a video without annotations gets one
    zero mask per frame (instance 0, annotation and category -1).
    """
    # Instance numbers run per video; ids are spread over buckets, so a video with
    # very many annotations is numbered by several tasks.
    numbered = dense_index(
        annotations.select("video_id", F.col("id").alias("annotation_id"), "category_id"),
        ["annotation_id"],
        int_bucket("annotation_id", 4096),
        "instance",
        partition=["video_id"],
    )
    per_video = videos.select("video_id", "length").join(numbered, "video_id", "left")
    per_frame = per_video.withColumn(
        "frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1))
    )
    joined = per_frame.join(
        segments.select("annotation_id", "frame_index", "area"), ["annotation_id", "frame_index"], "left"
    )
    return joined.select(
        "video_id",
        "frame_index",
        F.coalesce("instance", F.lit(0)).cast("long").alias("instance"),
        F.coalesce("annotation_id", F.lit(-1)).cast("long").alias("annotation_id"),
        F.coalesce("category_id", F.lit(-1)).cast("long").alias("category_id"),
        F.coalesce("area", F.lit(0.0)).cast("double").alias("area"),
        F.col("area").isNull().alias("is_empty"),
    )


def results_without_video(results: DataFrame, videos: DataFrame) -> DataFrame:
    """Result rows whose video is unknown; expected empty."""
    return results.join(videos.select("video_id"), "video_id", "left_anti")


def require_known_videos(results: DataFrame, videos: DataFrame) -> DataFrame:
    marked = results.join(videos.select("video_id", F.lit(True).alias("__known")), "video_id", "left")
    return marked.withColumn(
        "video_id",
        F.when(F.col("__known"), F.col("video_id")).otherwise(
            F.raise_error(F.lit("results name a video that is not in the ground truth"))
        ),
    ).drop("__known")


def mean_area(areas: Column) -> Column:
    """Mean of the non-zero, non-null areas; 0 if there is none."""
    kept = F.filter(areas, lambda a: a.isNotNull() & (a != 0))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, a: acc + a)
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))


def segment_areas(segments: DataFrame, key: str, area: str = "area") -> DataFrame:
    """(key, avg_area) from one row per segment, for results kept as a long table."""
    kept = F.when(F.col(area) != 0, F.col(area))
    return segments.groupBy(key).agg(F.coalesce(F.avg(kept), F.lit(0.0)).alias("avg_area"))


def enrich_results(results: DataFrame, order: Sequence[str], bucket: Column, areas: str | None = None) -> DataFrame:
    """Adds id (position from 1 in `order`), avg_area and iscrowd = 0.

    The mean area comes from the array column `areas`, or stays as it is when None.
    """
    numbered = dense_index(results, order, bucket, "id").withColumn("id", F.col("id") + 1)
    if areas is not None:
        numbered = numbered.withColumn("avg_area", mean_area(F.col(areas)))
    return numbered.withColumn("iscrowd", F.lit(0).cast("long"))


def max_instances(annotations: DataFrame, video: str = "video_id") -> DataFrame:
    return annotations.groupBy(video).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("max_instances")
    )


def rle_area(counts: Column) -> Column:
    """Set pixels of an uncompressed run-length mask: the runs at odd positions."""
    odd = F.filter(counts, lambda _, i: i % 2 == 1)
    return F.aggregate(odd, F.lit(0).cast("long"), lambda acc, n: acc + n)


def rle_total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, n: acc + n)


@F.arrow_udf(T.ArrayType(T.LongType()))
def rle_starts(counts: pa.Array) -> pa.Array:
    """First pixel of each run: the sum of all runs before it, for whole batches of masks at once.

    A fold over an array in SQL copies what it has built at every step, which is quadratic; this is linear and moves no
    run to another task. After a null length positions are unknown, so later starts are null.
    """
    sizes = pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = np.repeat(ends - sizes, sizes)
    lengths = counts.flatten().cast(pa.int64())
    missing = lengths.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    filled = lengths.fill_null(0).to_numpy(zero_copy_only=False)

    def before(values: np.ndarray) -> np.ndarray:
        total = np.cumsum(values) - values
        return total - total[first]

    starts = pa.array(before(filled), pa.int64(), mask=before(missing) > 0)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, starts, mask=counts.is_null())


@F.arrow_udf(T.StructType().add("intersection", T.LongType()).add("union", T.LongType()))
def rle_overlap(one: pa.Array, other: pa.Array) -> pa.Array:
    """Pixels in both and in either of two run-length masks of one frame, from their runs, not their pixels.

    The borders of both masks cut the frame into stretches that are wholly in or out of each. Beyond its last run a mask is
    empty. A null mask, or one with a null length, gives null. All rows of a batch are cut at once.
    """
    n, sides = len(one), (one, other)
    rows, places, marks, known, totals = [np.arange(n)], [np.zeros(n, np.int64)], [np.zeros(n, np.int64)], np.ones(n, bool), []
    for side, counts in enumerate(sides):
        lengths = counts.value_lengths().fill_null(0).to_numpy()
        values = counts.flatten()
        row = np.repeat(np.arange(n), lengths)
        bad = ~np.isfinite(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
        known &= counts.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[bad], minlength=n) == 0)
        runs = values.to_numpy(zero_copy_only=False)
        borders = np.cumsum(np.where(bad, 0, runs).astype(np.int64))
        first = np.cumsum(lengths) - lengths
        borders -= np.repeat(np.concatenate([[0], borders])[first], lengths)
        rows, places, marks = [*rows, row], [*places, borders], [*marks, np.full(len(row), side + 1)]
        totals.append(lengths)
    row, place, mark = (np.concatenate(x) for x in (rows, places, marks))
    order = np.lexsort((place, row))
    row, place, mark = row[order], place[order], mark[order]
    # a stretch goes from a border to the next one of its row; the last border of a row ends the last stretch
    width = np.append(np.diff(place), 0) * np.append(row[1:] == row[:-1], False)
    starts = np.searchsorted(row, np.arange(n))
    inside = []
    for side, lengths in enumerate(totals):
        passed = np.cumsum(mark == side + 1)
        passed -= np.repeat(np.cumsum(lengths) - lengths, np.diff(np.append(starts, len(row))))
        # set between an odd and an even border; a mask that ends in a set run has no border after it
        inside.append((passed % 2 == 1) & (passed < lengths[row]))
    sums = [np.add.reduceat(np.where(held, width, 0), starts) if n else np.zeros(0, np.int64) for held in (inside[0] & inside[1], inside[0] | inside[1])]
    found = [pa.array(x, pa.int64()) for x in sums]
    return pa.StructArray.from_arrays(found, ["intersection", "union"], mask=pa.array(~known))


def rle_boxes(df: DataFrame, keys: Sequence[str], height: Column, counts: str = "counts") -> DataFrame:
    """(keys, x, y, width, height, area) of each mask's smallest box, from its runs in column-major order.

    A run that goes on into the next column touches both the first and the last row. A mask without a set pixel has the
    box 0, 0, 0, 0; a null mask has nulls.
    """
    lengths = F.col(counts).cast("array<bigint>")
    runs = F.arrays_zip(rle_starts(lengths).alias("start"), lengths.alias("length"))
    kept = F.filter(runs, lambda run, i: (i % 2 == 1) & (run["length"] > 0))
    rows = df.select(*keys, height.cast("long").alias("__h"), kept.alias("__runs"))
    h = F.col("__h")
    last = lambda run: run["start"] + run["length"] - 1

    def least(value) -> Column:
        return F.array_min(F.transform("__runs", value))

    def most(value) -> Column:
        return F.array_max(F.transform("__runs", value))

    crosses = lambda run: div(run["start"], h) != div(last(run), h)
    edges = rows.select(
        *keys,
        "__runs",
        least(lambda r: div(r["start"], h)).alias("__left"),
        most(lambda r: div(last(r), h)).alias("__right"),
        least(lambda r: F.when(crosses(r), F.lit(0)).otherwise(F.pmod(r["start"], h))).alias("__top"),
        most(lambda r: F.when(crosses(r), h - 1).otherwise(F.pmod(last(r), h))).alias("__bottom"),
    )
    known = F.col("__runs").isNotNull()

    def or_zero(value: Column) -> Column:
        return F.when(known, F.coalesce(value, F.lit(0)).cast("long"))

    area = F.aggregate("__runs", F.lit(0).cast("long"), lambda total, run: total + run["length"])
    return edges.select(
        *keys,
        or_zero(F.col("__left")).alias("x"),
        or_zero(F.col("__top")).alias("y"),
        or_zero(F.col("__right") - F.col("__left") + 1).alias("width"),
        or_zero(F.col("__bottom") - F.col("__top") + 1).alias("height"),
        area.alias("area"),
    )


def rle_runs(df: DataFrame, keys: Sequence[str], counts: str = "counts") -> DataFrame:
    """(keys, run_start, run_length) of the set runs, in column-major pixel order."""
    lengths = F.col(counts).cast("array<bigint>")
    runs = F.arrays_zip(rle_starts(lengths).alias("start"), lengths.alias("length"))
    return df.select(*keys, F.posexplode(runs).alias("pos", "run")).filter("pos % 2 = 1").select(
        *keys, F.col("run.start").alias("run_start"), F.col("run.length").alias("run_length")
    )


def rle_decode(df: DataFrame, keys: Sequence[str], height: Column, counts: str = "counts") -> DataFrame:
    """(keys, y, x) of every set pixel."""
    runs = rle_runs(df.withColumn("__h", height), [*keys, "__h"], counts).filter("run_length > 0")
    pixel = F.explode(F.sequence(F.col("run_start"), F.col("run_start") + F.col("run_length") - 1))
    return runs.select(*keys, "__h", pixel.alias("__p")).select(
        *keys,
        F.pmod("__p", "__h").cast("long").alias("y"),
        div("__p", "__h").alias("x"),
    )


