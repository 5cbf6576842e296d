"""Chunks, shards, batches, padding, epochs and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_bits, hash_uniform
from ..functions.integers import div

PADDING = "PADDING"


def split_to_chunks(frames: DataFrame, chunk_size: int, key: str = "key") -> DataFrame:
    """Adds chunk and chunk_key; drops the frames of an incomplete last chunk.

    Needs frame_index and the sequence `length` on every row, so chunking is a
    projection and a filter. Columns that are not per frame simply repeat.
    """
    chunk = div("frame_index", chunk_size)
    return (
        frames.withColumn("chunk", chunk)
        .filter(F.col("chunk") < div("length", chunk_size))
        .withColumn("frame_in_chunk", F.pmod("frame_index", F.lit(chunk_size)).cast("long"))
        .withColumn("chunk_key", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk").cast("string")))
    )


def one_chunk_per_video(chunked: DataFrame, key: str, chunk_size: int, seed: int = 0) -> DataFrame:
    """Keeps one hash-chosen chunk of every video.

    The chunk number is computed from the key and length alone, so nothing is
    grouped or ranked.
    """
    n_chunks = div("length", chunk_size)
    return chunked.filter(F.col("chunk") == F.floor(hash_uniform(seed, key) * n_chunks))


def explode_frames(videos: DataFrame, length: str = "length") -> DataFrame:
    """One row per frame of every video row."""
    return videos.withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length) - 1)))


def expected_sample_counts(n_samples: Column, video_size: int | None, chunk_size: int | None, one_chunk: bool = False) -> Column:
    """Samples after chunking; null when the video size is needed and unknown."""
    if chunk_size is None or one_chunk:
        return n_samples.cast("long")
    if video_size is None:
        return F.lit(None).cast("long")
    return div(n_samples * video_size, chunk_size)


def round_robin_shards(rows: DataFrame, world_size: int, index: str = "row_id") -> DataFrame:
    """Adds rank and the position inside the rank: rank r takes rows r, r + w, ..."""
    if world_size <= 0:
        raise ValueError("world size must be positive")
    return rows.withColumn("rank", F.pmod(index, F.lit(world_size)).cast("long")).withColumn(
        "position", div(index, world_size)
    )


def shard_length(total: Column, rank: Column, world_size: int) -> Column:
    return div(F.greatest(total - rank + (world_size - 1), F.lit(0)), world_size)


def assign_batches(rows: DataFrame, batch_size: int, total: Column, drop_last: bool, index: str = "row_id") -> DataFrame:
    """Adds batch and slot from a dense index; `drop_last` removes an incomplete last batch."""
    out = rows.withColumn("batch", div(index, batch_size)).withColumn(
        "slot", F.pmod(index, F.lit(batch_size)).cast("long")
    )
    return out.filter(F.col("batch") < div(total, batch_size)) if drop_last else out


def batches_per_epoch(n_samples: Column, batch_size: int, n_nodes: int = 1, partial: bool = False) -> Column:
    ratio = n_samples / F.lit(batch_size * n_nodes)
    return (F.ceil(ratio) if partial else F.floor(ratio)).cast("long")


def epoch_repeat(rows: DataFrame, total: Column, n_out: Column, index: str = "row_id") -> DataFrame:
    """Cycles through the rows until `n_out` positions are filled; adds position.

    Row r fills r, r + total, r + 2 total, ...: an explode per row, no sort.
    """
    first = F.col(index)
    spots = F.when(first < n_out, F.sequence(first, n_out - 1, total)).otherwise(
        F.array().cast("array<bigint>")
    )
    return rows.withColumn("position", F.explode(spots))


def assign_shards(rows: DataFrame, maxcount: int, pattern: str = "shard-%06d.tar", index: str = "row_id") -> DataFrame:
    """Adds shard_id, the position in the shard and the file name; at most `maxcount` rows each."""
    return (
        rows.withColumn("shard_id", div(index, maxcount))
        .withColumn("shard_pos", F.pmod(index, F.lit(maxcount)).cast("long"))
        .withColumn("shard_file", F.format_string(pattern, F.col("shard_id")))
    )


def resampled_shards(draws: DataFrame, n_shards: Column, seed: int = 0, draw: str = "draw") -> DataFrame:
    """Adds shard_id, drawn with replacement and repeatable."""
    return draws.withColumn("shard_id", F.pmod(hash_bits(seed, draw), n_shards).cast("long"))


def max_samples_per_worker(n_samples: Column, n_shards: Column, n_nodes: int, n_workers: int) -> Column:
    per_shard = F.ceil(n_samples / n_shards)
    per_node = F.ceil(n_shards / F.lit(n_nodes))
    return (F.ceil(per_node / F.lit(max(n_workers, 1))) * per_shard).cast("long")


def shard_balance(sizes: DataFrame, n_nodes: int, n_workers: int, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Per split: shards, samples, the per-worker bound, and whether nodes and workers fit."""
    per_node = div("n_shards", n_nodes)
    return (
        sizes.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_shards"), F.sum("n_samples").alias("n_samples"))
        .withColumn(
            "max_per_worker",
            max_samples_per_worker(F.col("n_samples"), F.col("n_shards"), n_nodes, n_workers),
        )
        .withColumn("enough_shards", per_node >= 1)
        .withColumn("workers_fit", per_node >= n_workers)
    )


FILLER_RUN = 4096


def _filler(kind: T.DataType, example: Column) -> Column:
    """Filler of a type; arrays take their length from the example."""
    if isinstance(kind, T.StringType):
        return F.lit(PADDING)
    if isinstance(kind, T.ArrayType):
        return F.transform(example, lambda x: _filler(kind.elementType, x))
    if isinstance(kind, (T.MapType, T.StructType, T.BinaryType)):
        return F.lit(None).cast(kind)
    return F.lit(0).cast(kind)


def pad_to_size(rows: DataFrame, size: int | Column, worker: str = "worker") -> DataFrame:
    """Fills each worker's slice up to `size` rows and adds batch_padding_mask.

    Text is filled with a marker, numbers with zero, arrays with as many fillers as the
    worker's first array holds, other types with null. Filler comes in runs of FILLER_RUN
    rows, so no array grows with `size`.
    """
    size = F.lit(size) if isinstance(size, int) else size
    fields = [field for field in rows.schema.fields if field.name != worker]
    arrays = [field.name for field in fields if isinstance(field.dataType, T.ArrayType)]
    fill = {field.name: _filler(field.dataType, F.col(f"`{field.name}`")) for field in fields}
    missing = rows.groupBy(worker).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(f"`{name}`", ignorenulls=True).alias(name) for name in arrays]
    )
    need = (size - F.col("__n")).cast("long")
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__need") - 1, F.lit(FILLER_RUN).cast("long"))).alias("__from")
    place = F.sequence(F.col("__from"), F.least(F.col("__from") + FILLER_RUN, F.col("__need")) - 1)
    padding = (
        missing.withColumn("__need", need)
        .filter("__need > 0")
        .select(worker, *arrays, "__need", run)
        .withColumn("__place", F.explode(place))
        .select(worker, *[value.alias(name) for name, value in fill.items()])
        .withColumn("batch_padding_mask", F.lit(True))
    )
    return rows.withColumn("batch_padding_mask", F.lit(False)).unionByName(padding)


def remove_padding(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("batch_padding_mask")).drop("batch_padding_mask")


def exactly_once_check(rows: DataFrame, key: str, expected: int | Column) -> DataFrame:
    """One row: keys, distinct keys, expected count and the verdict; filler rows do not count."""
    expected = F.lit(expected) if isinstance(expected, int) else expected
    per_key = rows.filter(F.col(key) != PADDING).groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_keys"), F.count(F.lit(1)).alias("n_unique")
    ).select(
        "n_keys",
        "n_unique",
        expected.cast("long").alias("n_expected"),
        ((F.col("n_keys") == F.col("n_unique")) & (F.col("n_unique") == expected)).alias("exactly_once"),
    )


def topk_per_row(df: DataFrame, keys: Sequence[str], value: str, tie: str, k: int) -> DataFrame:
    """The k largest values per key, ties by the smaller `tie`; adds rank from 1."""
    window = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie))
    ranked = df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def random_flip_flag(seed: int, p: float, *keys: str) -> Column:
    return hash_uniform(seed, *keys) < F.lit(float(p))


