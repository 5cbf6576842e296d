"""Feature cache on disk: feature shards, sorted index, completion marker.

A cache folder holds `features/` (Parquet, one folder per shard, each row's features packed as
the bytes of its half or single floats), `index/` (Parquet sorted by row id) and `metadata/`
(one JSON row). A full shard holds just the bytes that its row count was worked out for. The marker is written first as
incomplete and last as complete, so an interrupted run is never read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import pack_matrix, unpack_matrix
from ..operators.cache_index import (
    feature_shape_ok,
    integrity_report,
    require_clean,
    rows_per_shard,
    shard_layout,
    sorted_index,
)
from ..operators.lookup import lookup_unique_key, multi_get
from ..schemas import CACHE_INDEX

CACHE_FORMAT = "sharded_parquet"
SCHEMA_VERSION = 1
INDEX_ROWS_PER_FILE = 4_000_000


def _read_metadata(spark: SparkSession, path: str):
    try:
        return spark.read.json(f"{path}/metadata").first()
    except AnalysisException:
        return None


def _write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    names, values = zip(*sorted(metadata.items()))
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    row.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_cache(
    features: DataFrame,
    path: str,
    shape: tuple[int, int],
    expected_rows: int,
    dtype: str = "float16",
    target_mb: float = 256.0,
    overwrite: bool = False,
    extra: dict | None = None,
) -> None:
    """Writes rows of provenance (with dataset columns) and `features` (slots x dim arrays).

    `expected_rows` is the number of frames planned. The result is checked from the
    files before the marker says complete.
    """
    spark = features.sparkSession
    if not overwrite and _read_metadata(spark, path) is not None:
        raise FileExistsError(f"{path} holds a cache already; pass overwrite")
    per_shard = rows_per_shard(shape, dtype, target_mb)
    metadata = {
        "schema_version": SCHEMA_VERSION,
        "cache_format": CACHE_FORMAT,
        "complete": False,
        "dtype": dtype,
        "slots": shape[0],
        "dim": shape[1],
        "rows_per_shard": per_shard,
        "expected_rows": expected_rows,
        **(extra or {}),
    }
    _write_metadata(spark, path, metadata)
    mode = "overwrite" if overwrite else "errorifexists"
    checked = features.withColumn(
        "features",
        F.when(feature_shape_ok(F.col("features"), *shape), F.col("features").cast("array<array<float>>")).otherwise(
            F.raise_error(F.lit(f"feature shape differs from {shape}"))
        ),
    ).withColumn("features", pack_matrix(F.col("features"), dtype))
    laid = shard_layout(checked, per_shard, F.lit(expected_rows))
    # One pass over the predictor: the index is derived from the written features.
    (
        laid.repartition("shard_id")
        .sortWithinPartitions("shard_id", "shard_offset")
        .write.mode(mode)
        .partitionBy("shard_id")
        .parquet(f"{path}/features")
    )
    stored = spark.read.parquet(f"{path}/features")
    index = stored.select(*[F.col(f.name).cast(f.dataType) for f in CACHE_INDEX.fields])
    sorted_index(index, expected_rows, INDEX_ROWS_PER_FILE).write.mode(mode).parquet(f"{path}/index")
    verify_cache(spark, path, expected_rows)
    n_shards = -(-expected_rows // per_shard)
    _write_metadata(spark, path, {**metadata, "complete": True, "num_rows": expected_rows, "num_shards": n_shards})


def stored_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard_path, actual_rows, feature_shape, stored_bytes) of the feature files; the shape is the bytes of a row."""
    size = F.octet_length("features")
    return (
        spark.read.parquet(f"{path}/features")
        .groupBy("shard_path", size.cast("string").alias("feature_shape"))
        .agg(F.count(F.lit(1)).alias("__n"), F.sum(size.cast("long")).alias("__bytes"))
        .groupBy("shard_path")
        .agg(
            F.sum("__n").alias("actual_rows"),
            F.max("feature_shape").alias("feature_shape"),
            F.sum("__bytes").alias("stored_bytes"),
        )
    )


def verify_cache(spark: SparkSession, path: str, expected_rows: int) -> None:
    index = spark.read.parquet(f"{path}/index")
    require_clean(integrity_report(spark, index, expected_rows, stored_shards(spark, path)))


class FeatureCache:
    """A finished cache; refuses an unknown format and an incomplete one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.metadata = _read_metadata(spark, path)
        if self.metadata is None:
            raise FileNotFoundError(f"no cache at {path}")
        if self.metadata["cache_format"] != CACHE_FORMAT:
            raise ValueError(f"unsupported cache format {self.metadata['cache_format']}")
        if not self.metadata["complete"]:
            raise ValueError(f"cache {path} is incomplete")
        self.index = spark.read.parquet(f"{path}/index")
        self.packed = spark.read.parquet(f"{path}/features").select("row_id", "features")

    @property
    def features(self) -> DataFrame:
        """(row_id, features) as arrays of floats."""
        return self._unpacked(self.packed)

    def _unpacked(self, rows: DataFrame) -> DataFrame:
        shape = (self.metadata[name] for name in ("slots", "dim", "dtype"))
        return rows.withColumn("features", unpack_matrix(F.col("features"), *shape))

    def lookup(self, requests: DataFrame, strict: bool = True) -> DataFrame:
        """Row ids by (dataset_index or repo_id, episode_index, frame_index)."""
        keys = [k for k in ("dataset_index", "repo_id") if k in requests.columns][:1]
        if not keys:
            raise ValueError("requests need dataset_index or repo_id")
        return lookup_unique_key(requests, self.index, [*keys, "episode_index", "frame_index"], strict=strict)

    def get_many(self, requests: DataFrame) -> DataFrame:
        """(position, row_id, features) in request order; an unknown id fails the job."""
        return self._unpacked(multi_get(requests, self.packed, "row_id"))  # packed bytes move
