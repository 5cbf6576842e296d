"""Column selection, renaming, casts and small filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import slice_range


def select_by_prefix(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Columns that start with one of the prefixes; names with a leading underscore always stay."""
    kept = [c for c in df.columns if c.startswith(("_", *prefixes))]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def filter_map_by_prefix(members: Column, prefixes: Sequence[str]) -> Column:
    """The same on a map column, for samples whose members are not known in advance."""
    return F.map_filter(
        members,
        lambda k, _: F.exists(F.array(*[F.lit(p) for p in ("_", *prefixes)]), lambda p: F.startswith(k, p)),
    )


def strip_extensions(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.split(".")[0] for c in df.columns])


def strip_map_extensions(members: Column) -> Column:
    return F.transform_keys(members, lambda k, _: F.substring_index(k, ".", 1))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Applies every pair; a missing source column is an error."""
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise KeyError(f"columns not found: {absent}")
    return df.withColumnsRenamed(names)


def duplicate_columns(df: DataFrame, copies: dict[str, str]) -> DataFrame:
    return df.withColumns({to: F.col(source) for source, to in copies.items()})


def project_cast(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """The named columns, cast where a type is given."""
    return df.select(*[F.col(c).cast(t) if t else F.col(c) for c, t in columns.items()])


def camera_keys(features: Column) -> Column:
    """Names of the video and image features in declared order."""
    return F.map_keys(F.map_filter(features, lambda _, f: f["dtype"].isin("video", "image")))


def choose_camera(features: Column, requested: str | None = None) -> Column:
    keys = camera_keys(features)
    if requested is None:
        return F.when(F.size(keys) > 0, F.get(keys, F.lit(0))).otherwise(
            F.raise_error(F.lit("dataset defines no camera"))
        )
    return F.when(F.array_contains(keys, requested), F.lit(requested)).otherwise(
        F.raise_error(F.concat(F.lit(f"camera `{requested}` not found in: "), F.array_join(keys, ", ")))
    )


def resolve_slice(
    prediction_dim: int,
    n_patches: int,
    configured: Sequence[int] | None = None,
    loss_dims: Sequence[int] | None = None,
) -> tuple[int, int]:
    """[start, stop) of the prediction vector: configured, else from the loss, else by its size."""
    chosen = configured if configured is not None else loss_dims
    if chosen is not None:
        if len(chosen) != 2:
            raise ValueError(f"expected a pair of dims, got {chosen}")
        start, stop = int(chosen[0]), int(chosen[1])
        if not 0 <= start < stop <= prediction_dim or stop - start != n_patches:
            raise ValueError(
                f"dims [{start}, {stop}) do not fit {prediction_dim} values and {n_patches} patches"
            )
        return start, stop
    if prediction_dim < n_patches:
        raise ValueError(f"{prediction_dim} values are fewer than {n_patches} patches")
    doubled = prediction_dim >= 2 * n_patches
    return (prediction_dim - n_patches, prediction_dim) if doubled else (0, n_patches)


def slice_vector(df: DataFrame, column: str, start: int, stop: int) -> DataFrame:
    return df.withColumn(column, slice_range(column, start, stop))


def drop_last_frames(frames: DataFrame, n: int, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """Drops the last n frames of every sequence.

    The lengths are a partial aggregate joined back, so a long sequence is not
    gathered in one task.
    """
    if n <= 0:
        return frames
    lengths = frames.groupBy(*keys).agg(F.max(frame).alias("__last"))
    return frames.join(lengths, list(keys)).filter(F.col(frame) <= F.col("__last") - n).drop("__last")


def last_step(frames: DataFrame, keys: Sequence[str], value: str, frame: str = "frame") -> DataFrame:
    """`value` at the last frame of every key; partial aggregation keeps one value per key and task."""
    return frames.groupBy(*keys).agg(
        F.max(frame).alias("last_frame"), F.max_by(value, frame).alias(value)
    )
