"""Episode tables, clamped temporal context and global row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import exclusive_prefix_sum, int_bucket

SPLITS = ("train", "val", "test")


def frame_offsets(num_frames: int, include_current: bool = True) -> list[int]:
    last = 0 if include_current else -1
    return [last - back for back in range(num_frames - 1, -1, -1)]


def delta_timestamps(offsets: Sequence[int], fps: Column) -> Column:
    """Offsets in seconds; a missing or non-positive fps is an error."""
    steps = F.array(*[F.lit(float(o)) for o in offsets])
    return F.when(fps > 0, F.transform(steps, lambda o: o / fps)).otherwise(
        F.raise_error(F.concat(F.lit("invalid fps: "), F.coalesce(fps.cast("string"), F.lit("null"))))
    )


def episode_offsets(episodes: DataFrame, keys: Sequence[str] = (), bucket_width: int = 65536) -> DataFrame:
    """Adds dataset_from_index and dataset_to_index: running frame range of every episode."""
    out = exclusive_prefix_sum(
        episodes,
        "length",
        ["episode_index"],
        int_bucket("episode_index", bucket_width),
        "dataset_from_index",
        partition=keys,
    )
    return out.withColumn("dataset_to_index", F.col("dataset_from_index") + F.col("length"))


def clamped_context(frames: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Adds context_absolute_indices, context_frame_indices and context_is_pad.

    Needs absolute_index, dataset_from_index and dataset_to_index on every row, so
    it is a projection: no neighbour row is read.
    """
    steps = F.array(*[F.lit(int(o)).cast("long") for o in offsets])
    raw = F.transform(steps, lambda o: F.col("absolute_index") + o)
    start, stop = F.col("dataset_from_index"), F.col("dataset_to_index")
    return (
        frames.withColumn(
            "context_absolute_indices",
            F.transform(raw, lambda i: F.greatest(start, F.least(stop - 1, i))),
        )
        .withColumn(
            "context_frame_indices", F.transform("context_absolute_indices", lambda i: i - start)
        )
        .withColumn("context_is_pad", F.transform(raw, lambda i: (i < start) | (i >= stop)))
    )


def context_timestamps(frames: DataFrame, fps: Column) -> DataFrame:
    """Adds query_timestamps, seconds from the episode start of every context frame."""
    return frames.withColumn(
        "query_timestamps", F.transform("context_frame_indices", lambda i: i / fps)
    )


def frames_full_context(frames: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Frames whose whole context lies inside the episode; needs frame_index and length."""
    low, high = max(0, -min(offsets)), max(0, max(offsets))
    return frames.filter(
        (F.col("frame_index") >= low) & (F.col("frame_index") < F.col("length") - high)
    )


#: Frames that one task gathers.
GATHERED = 1 << 18


def gather_context(
    frames: DataFrame, value: str, offsets: Sequence[int], keys: Sequence[str] = ("episode_index",), rows: int | None = None
) -> DataFrame:
    """(keys, frame_index, values): `value` at every clamped context position, in offset order.

    Each row sends its value to the frames that look at it, so one shuffle on
    (keys, frame) does the gather; a group never holds more than len(offsets) values.
    Such rows compress to a few bytes, so tasks that are sized by bytes hold very many groups. With `rows`, about the
    number of frames, a task gathers about `GATHERED` frames at any size of the table.
    """
    frame, length = F.col("frame_index"), F.col("length")

    def readers(slot: int, offset: int) -> Column:
        # Frames f with clamp(f + offset) equal to this frame.
        low = F.when(frame == 0, F.lit(0)).otherwise(frame - offset)
        high = F.when(frame == length - 1, length - 1).otherwise(frame - offset)
        low, high = F.greatest(low, F.lit(0)), F.least(high, length - 1)
        targets = F.when(low <= high, F.sequence(low, high)).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.transform(
            targets, lambda f: F.struct(f.alias("frame"), F.lit(slot).alias("slot"))
        )

    sends = F.flatten(F.array(*[readers(j, int(o)) for j, o in enumerate(offsets)]))
    sent = frames.select(*keys, F.col(value).alias("__value"), F.explode(sends).alias("__to"))
    if rows is not None:
        sent = sent.withColumn("__frame", F.col("__to.frame")).repartition(max(1, -(-rows // GATHERED)), *keys, "__frame")
        sent = sent.withColumn("__to", F.struct(F.col("__frame").alias("frame"), F.col("__to.slot").alias("slot")))
    # One fixed slot per offset keeps the aggregate hashed and combines on the map side.
    slots = [
        F.max(F.when(F.col("__to.slot") == j, F.col("__value"))).alias(f"__v{j}") for j in range(len(offsets))
    ]
    return (
        sent.groupBy(*keys, F.col("__to.frame").alias("frame_index"))
        .agg(*slots)
        .select(*keys, "frame_index", F.array(*[F.col(f"__v{j}") for j in range(len(offsets))]).alias("values"))
    )


def attach_tasks(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adds the task text, empty where the task table has no row."""
    return frames.join(tasks.select("task_index", "task"), "task_index", "left").withColumn(
        "task", F.coalesce("task", F.lit(""))
    )


def attach_dataset_info(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Adds repo_id, root and camera_key of the row's dataset."""
    return rows.join(info.select("dataset_index", "repo_id", "root", "camera_key"), "dataset_index")


def split_rank(column: str = "split", order: Sequence[str] = SPLITS) -> Column:
    rank = F.lit(None).cast("long")
    for position, name in enumerate(order):
        rank = F.when(F.col(column) == name, F.lit(position).cast("long")).otherwise(rank)
    return rank


def cache_row_ids(
    frames: DataFrame,
    episodes: DataFrame,
    splits: Sequence[str] = SPLITS,
    bucket_width: int = 65536,
) -> DataFrame:
    """Dense row_id over (requested split order, dataset, episode, frame).

    `episodes` has one row per (dataset_index, episode_index) with split and
    length; its other columns go along. Frames are only joined to their episode's
    first id: the id of a frame is that plus its frame_index, and no window runs
    over frames.
    """
    unknown = [s for s in splits if s not in SPLITS]
    if unknown:
        raise ValueError(f"unknown splits: {unknown}")
    chosen = episodes.withColumn("split_index", split_rank(order=splits)).filter("split_index is not null")
    bucket = F.struct("split_index", "dataset_index", int_bucket("episode_index", bucket_width).alias("chunk"))
    first = exclusive_prefix_sum(
        chosen, "length", ["split_index", "dataset_index", "episode_index"], bucket, "first_row"
    )
    return (
        frames.join(first, ["dataset_index", "episode_index"])
        .withColumn("row_id", F.col("first_row") + F.col("frame_index"))
        .drop("first_row")
    )


def relative_index(
    frames: DataFrame,
    episodes: DataFrame,
    selected: DataFrame,
    missing: int | None = None,
) -> DataFrame:
    """Adds relative_index: position among the frames of the selected episodes, else `missing`."""
    chosen = episodes.join(selected.select("episode_index").distinct(), "episode_index", "left_semi")
    first = exclusive_prefix_sum(
        chosen, "length", ["episode_index"], int_bucket("episode_index"), "first_row"
    ).select("episode_index", "first_row")
    position = F.col("first_row") + F.col("frame_index")
    if missing is not None:
        position = F.coalesce(position, F.lit(missing).cast("long"))
    return frames.join(first, "episode_index", "left").withColumn("relative_index", position).drop("first_row")


def episode_contiguity(episodes: DataFrame, declared_total: int | DataFrame) -> DataFrame:
    """One row: row count, declared count, and how many ids break the run 0..n-1.

    A run of n distinct ids with minimum 0 and maximum n-1 is contiguous, so plain
    aggregates are enough.
    """
    stats = episodes.groupBy("episode_index").agg(F.count(F.lit(1)).alias("copies")).agg(
        F.sum("copies").alias("n_rows"),
        F.count(F.lit(1)).alias("n_ids"),
        F.min("episode_index").alias("min_id"),
        F.max("episode_index").alias("max_id"),
        F.sum((F.col("episode_index") < 0).cast("long")).alias("n_negative"),
    )
    declared = (
        F.lit(declared_total).cast("long")
        if isinstance(declared_total, int)
        else declared_total.scalar().cast("long")
    )
    return stats.withColumn("declared", declared).select(
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        "declared",
        (F.coalesce("n_rows", F.lit(0)) == F.col("declared")).alias("count_matches"),
        (F.coalesce("max_id", F.lit(-1)) + 1 - F.col("n_ids") + F.coalesce("n_negative", F.lit(0))).alias("n_gaps"),
        (F.coalesce("n_rows", F.lit(0)) - F.col("n_ids")).alias("n_duplicates"),
    )
