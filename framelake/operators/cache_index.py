"""Layout, index and integrity of a sharded feature cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.integers import div
from ..functions.vectors import array_sum, let
from ..schemas import CACHE_INDEX

ITEM_BYTES = {"float16": 2, "float32": 4}


def rows_per_shard(shape: Sequence[int], dtype: str, target_mb: float) -> int:
    if target_mb <= 0:
        raise ValueError("target shard size must be positive")
    if dtype not in ITEM_BYTES:
        raise ValueError(f"unsupported cache dtype {dtype}")
    row_bytes = ITEM_BYTES[dtype]
    for extent in shape:
        row_bytes *= extent
    return max(1, int(target_mb * 1024 * 1024) // max(row_bytes, 1))


def shard_layout(rows: DataFrame, per_shard: int, total: Column, row_id: str = "row_id") -> DataFrame:
    """Adds shard_id, shard_path, shard_offset and shard_num_rows.

    Row ids are dense, so every value is arithmetic on the id: no window, no shuffle.
    """
    shard = div(row_id, per_shard)
    return (
        rows.withColumn("shard_id", shard)
        .withColumn("shard_path", F.format_string("features/shard_id=%d", F.col("shard_id")))
        .withColumn("shard_offset", F.pmod(row_id, F.lit(per_shard)).cast("long"))
        .withColumn(
            "shard_num_rows",
            F.least(F.lit(per_shard), total - F.col("shard_id") * per_shard).cast("long"),
        )
    )


def feature_shape_ok(features: Column, slots: int, dim: int) -> Column:
    return (F.size(features) == slots) & F.forall(features, lambda slot: F.size(slot) == dim)


def sorted_index(fragments: DataFrame, total: int, per_partition: int = 1_000_000) -> DataFrame:
    """The index in row order: equal id ranges of at most `per_partition` rows, each sorted.

    Ids are dense, so a row's range is arithmetic; a sampled range partitioning would
    run the whole upstream plan twice.
    """
    missing = [f.name for f in CACHE_INDEX.fields if f.name not in fragments.columns]
    if missing:
        raise ValueError(f"index fragments are missing fields: {missing}")
    n_partitions = max(1, -(-total // per_partition))
    spot = div("row_id", per_partition).cast("int")
    ranged = F.greatest(F.lit(0), F.least(spot, F.lit(n_partitions - 1)))
    return fragments.repartitionById(n_partitions, ranged).sortWithinPartitions("row_id")


# The checks of an index.
CHECKS = (
    "row_out_of_bounds", "duplicate_row", "missing_row", "missing_shard", "shard_row_count", "shard_offset",
    "feature_shape",
)


#: Ids of one bucket of the integrity pass, and buckets that are merged at a time.
BUCKET, MERGED = 32_768, 1024


def integrity_report(
    spark: SparkSession, index: DataFrame, expected: int, shards: DataFrame, top: int = 10
) -> DataFrame:
    """(check, n_bad, examples): one row per violated or passed check of an index.

    `shards` holds the real content: shard_path, actual_rows, feature_shape.
    One pass: rows are counted per id (map-side first, so a hot id is one row), ids per bucket of
    `BUCKET` dense ids. A bucket of the expected range that lacks ids gives its absent ones from
    its own ids, so no range of all ids is joined. Buckets keep the `top` smallest ids of each check, and are
    merged `MERGED` at a time before the last step: no group is larger than that, however
    many rows violate a check.
    """
    row, bucket = F.col("row_id"), F.col("bucket")
    offset, actual = F.col("shard_offset"), F.col("actual_rows")
    of_rows = {
        "missing_shard": actual.isNull(),
        "shard_row_count": F.col("shard_num_rows") != actual,
        "shard_offset": (offset < 0) | (offset >= actual),
    }
    joined = index.join(shards.select("shard_path", "actual_rows"), "shard_path", "left")
    per_id = (
        joined.groupBy(div("row_id", BUCKET).cast("long").alias("bucket"), "row_id")
        .agg(F.count(F.lit(1)).alias("copies"), *(F.count_if(c).alias(name) for name, c in of_rows.items()))
        .select(
            "bucket",
            "row_id",
            *of_rows,
            ((row < 0) | (row >= expected)).cast("long").alias("row_out_of_bounds"),
            (row.isNotNull() & (F.col("copies") > 1)).cast("long").alias("duplicate_row"),
        )
    )
    counted = [name for name in CHECKS if name in per_id.columns]
    every = spark.range(-(-expected // BUCKET)).select(F.col("id").alias("bucket"))
    low = bucket * BUCKET
    high = F.least(low + BUCKET, F.lit(expected))
    within = F.filter("ids", lambda i: (i >= 0) & (i < expected))
    absent = F.when((low >= 0) & (low < expected), high - low - F.size(within)).otherwise(0)

    def first(ids: Column) -> Column:
        return F.slice(F.array_sort(ids), 1, top)

    def repeated(name: str) -> Column:  # an id stands once for each row that violates the check
        return F.when(F.col(name) > 0, F.array_repeat("row_id", F.least(F.col(name), F.lit(top)).cast("int")))

    per_bucket = (
        per_id.unionByName(every, allowMissingColumns=True)
        .groupBy("bucket")
        .agg(
            F.collect_list("row_id").alias("ids"),
            *(F.sum(name).alias(name) for name in counted),
            *(first(F.flatten(F.collect_list(repeated(name)))).alias(f"{name}_ids") for name in counted),
        )
        .withColumn("missing_row", absent)
        .withColumn(
            "missing_row_ids",
            F.when(absent > 0, first(F.array_except(F.sequence(low, high - 1), within))).otherwise(
                F.array().cast("array<long>")
            ),
        )
    )
    names = [*counted, "missing_row"]

    def merged(rows: DataFrame, *keys: Column) -> DataFrame:
        return rows.groupBy(*keys).agg(
            *(F.sum(name).alias(name) for name in names),
            *(first(F.flatten(F.collect_list(f"{name}_ids"))).alias(f"{name}_ids") for name in names),
        )

    whole = merged(merged(per_bucket, div("bucket", MERGED).alias("part")))
    shapes = shards.agg(F.greatest(F.count_distinct("feature_shape") - 1, F.lit(0)).alias("n"))
    lines = [
        F.struct(
            F.lit(name).alias("check"),
            F.coalesce(F.col(name), F.lit(0)).cast("long").alias("n_bad"),
            joined_ids(F.array_compact(F.coalesce(f"{name}_ids", F.array().cast("array<long>")))).alias("examples"),
        )
        for name in CHECKS
        if name in names
    ]
    return (
        whole.select(F.explode(F.array(*lines)).alias("line"))
        .select("line.*")
        .unionByName(shapes.select(F.lit("feature_shape").alias("check"), F.col("n").alias("n_bad"), F.lit("").alias("examples")))
    )


def joined_ids(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def require_clean(report: DataFrame) -> None:
    """Raises on the first violated check; the report has one row per check."""
    bad = report.filter("n_bad > 0").orderBy("check").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['n_bad']} ({r['examples']})" for r in bad))


def cache_summary(index: DataFrame) -> DataFrame:
    return index.groupBy("split", "dataset_index").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("shard_path").alias("n_shards")
    )


def feature_stats(features: DataFrame, column: str, keys: Sequence[str] = (), first: int = 8) -> DataFrame:
    """Per row: min, max, mean, population deviation and the first values of its vector."""
    v = F.col(column).cast("array<double>")
    n = F.size(v)
    mean = array_sum(v) / n
    spread = let(mean, lambda m: array_sum(F.transform(v, lambda x: (x - m) * (x - m)))) / n
    return features.select(
        *keys,
        F.array_min(v).alias("min_value"),
        F.array_max(v).alias("max_value"),
        mean.alias("mean_value"),
        F.sqrt(spread).alias("std_value"),
        F.slice(v, 1, first).alias("first_values"),
    )
