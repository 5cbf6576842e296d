"""Queries over the feature cache: layout, index, lookups."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_doubles
from ..operators import cache_index as ops
from ..operators import lookup
from ..operators.episodes import attach_dataset_info, cache_row_ids, clamped_context, frame_offsets
from ..operators.udfs import map_columns, predict_features as predict
from ..session import ensure_checkpoint_dir
from ..sources.cache_store import FeatureCache, stored_shards, write_cache
from . import views as v
from .registry import joined, micros, query, r6, s6, smicros

# Vectors of 64 floats seen as 4 slots of 16; small shards so that several exist.
SHAPE = (4, 16)
PER_SHARD = ops.rows_per_shard(SHAPE, "float32", 0.015625)


def vectors(spark, sf):
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"))


def vector_count(spark, sf):
    return v.table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()


@query(
    "cache_shard_layout",
    f"""SELECT vec_id AS row_id, 'features/shard_id=' || (vec_id // {PER_SHARD}) AS shard_path,
    vec_id % {PER_SHARD} AS shard_offset, count(*) OVER (PARTITION BY vec_id // {PER_SHARD}) AS shard_num_rows FROM embeddings""",
)
def cache_shard_layout(spark, sf):
    laid = ops.shard_layout(vectors(spark, sf), PER_SHARD, vector_count(spark, sf))
    return laid.select("row_id", "shard_path", "shard_offset", "shard_num_rows")


def frame_index(spark, sf, per_shard: int = 4096):
    """(full cache index of the mixed frames, its row count)."""
    plan = v.episode_plan(spark, sf)
    total = plan.agg(F.sum("length")).first()[0]  # of the written plan
    rows = cache_row_ids(v.mixed_turns(spark, sf), plan).withColumn(
        "absolute_index", F.col("dataset_from_index") + F.col("frame_index")
    )
    described = attach_dataset_info(clamped_context(rows, frame_offsets(2)), v.dataset_info(spark, sf))
    return ops.shard_layout(described, per_shard, F.lit(total)), total


INDEX_SQL = v.with_views(
    "cache_rows",
    extra={
        "idx": """SELECT *, 'features/shard_id=' || (row_id // 4096) AS shard_path, row_id % 4096 AS shard_offset,
          count(*) OVER (PARTITION BY row_id // 4096) AS shard_num_rows,
          greatest(dataset_from_index, absolute_index - 1) || ',' || absolute_index AS context_absolute_indices FROM cache_rows"""
    },
)


@query(
    "cache_index_sorted",
    INDEX_SQL
    + """SELECT row_id, split, dataset_index, episode_index, frame_index, context_absolute_indices,
    shard_path, shard_offset, shard_num_rows FROM idx""",
)
def cache_index_sorted(spark, sf):
    index, total = frame_index(spark, sf)
    index = ops.sorted_index(index, total)
    return index.select(
        "row_id",
        "split",
        "dataset_index",
        "episode_index",
        "frame_index",
        joined("context_absolute_indices").alias("context_absolute_indices"),
        "shard_path",
        "shard_offset",
        "shard_num_rows",
    )


@query(
    "cache_summary",
    INDEX_SQL + "SELECT split, dataset_index, count(*) AS n_rows, count(DISTINCT shard_path) AS n_shards FROM idx GROUP BY ALL",
)
def cache_summary(spark, sf):
    return ops.cache_summary(frame_index(spark, sf)[0])


@query("head_n", v.with_views("cache_rows") + "SELECT row_id, split, episode_index, frame_index FROM cache_rows ORDER BY row_id LIMIT 20")
def head_n(spark, sf):
    """The first rows of the index, as the summary prints them."""
    rows = cache_row_ids(v.mixed_turns(spark, sf), v.episode_plan(spark, sf))
    return rows.select("row_id", "split", "episode_index", "frame_index").orderBy("row_id").limit(20)


# Part keys of the order lines as an index with repeats, against the supplier table's size.
BROKEN_SQL = """WITH idx AS (SELECT l_partkey AS row_id, 'shard-' || l_returnflag AS shard_path,
      l_linenumber - 1 AS shard_offset, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS shard_num_rows FROM lineitem),
    shards AS (SELECT 'shard-' || l_returnflag AS shard_path, count(*) AS actual_rows FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    ids AS (SELECT row_id, count(*) AS copies FROM idx GROUP BY 1),
    expected AS (SELECT count(*) + 5 AS n FROM part),
    m AS (SELECT i.*, s.actual_rows FROM idx i LEFT JOIN shards s USING (shard_path)),
    bad AS (
      SELECT 'row_out_of_bounds' AS "check", row_id FROM ids, expected WHERE row_id < 0 OR row_id >= n
      UNION ALL SELECT 'duplicate_row', row_id FROM ids WHERE copies > 1
      UNION ALL SELECT 'missing_row', r.i FROM (SELECT unnest(range(n)) AS i FROM expected) r WHERE r.i NOT IN (SELECT row_id FROM ids)
      UNION ALL SELECT 'missing_shard', row_id FROM m WHERE actual_rows IS NULL
      UNION ALL SELECT 'shard_row_count', row_id FROM m WHERE shard_num_rows <> actual_rows
      UNION ALL SELECT 'shard_offset', row_id FROM m WHERE shard_offset < 0 OR shard_offset >= actual_rows),
    names AS (SELECT unnest(['row_out_of_bounds','duplicate_row','missing_row','missing_shard','shard_row_count','shard_offset']) AS "check"),
    top AS (SELECT "check", row_id, row_number() OVER (PARTITION BY "check" ORDER BY row_id) AS k FROM bad)
    SELECT n."check", count(b.row_id) AS n_bad, coalesce((SELECT string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id)
      FROM top t WHERE t."check" = n."check" AND k <= 10), '') AS examples
    FROM names n LEFT JOIN bad b ON b."check" = n."check" GROUP BY n."check"
    UNION ALL SELECT 'feature_shape', 1, ''"""


@query("cache_index_integrity", BROKEN_SQL)
def cache_index_integrity(spark, sf):
    """A deliberately broken index: order lines by part key, one shard missing, shapes that differ."""
    lines = v.table(spark, sf, "lineitem")
    n_a = lines.filter("l_returnflag = 'A'").agg(F.count(F.lit(1))).scalar()
    index = lines.select(
        F.col("l_partkey").alias("row_id"),
        F.concat(F.lit("shard-"), "l_returnflag").alias("shard_path"),
        (F.col("l_linenumber") - 1).cast("long").alias("shard_offset"),
        n_a.alias("shard_num_rows"),
    )
    shards = (
        lines.filter("l_returnflag <> 'R'")
        .groupBy(F.concat(F.lit("shard-"), "l_returnflag").alias("shard_path"))
        .agg(F.count(F.lit(1)).alias("actual_rows"))
        .withColumn("feature_shape", F.when(F.col("shard_path") == "shard-A", "4,16").otherwise("4,8"))
    )
    # Reading the expected size is the one driver-side number, as in the finished cache's metadata.
    expected = v.table(spark, sf, "part").count() + 5
    return ops.integrity_report(spark, index, expected, shards)


# Half floats: 4 x 16 items take 128 bytes a row, 64 KB hold 512 rows.
HALF_PER_SHARD = ops.rows_per_shard(SHAPE, "float16", 0.0625)


@query(
    "cache_roundtrip",
    f"""WITH n AS (SELECT count(*) AS total FROM embeddings),
    r AS (SELECT vec_id AS row_id, vec_id // {HALF_PER_SHARD} AS shard, list_transform(embedding, lambda x: floor(x::DOUBLE * 64) / 64) AS e FROM embeddings)
    SELECT row_id, 'features/shard_id=' || shard AS shard_path, {smicros('e')} AS features,
    least({HALF_PER_SHARD}, total - shard * {HALF_PER_SHARD}) * 128 AS stored_bytes,
    true AS complete, total AS num_rows, 'refused' AS second_write FROM r, n""",
)
def cache_roundtrip(spark, sf):
    """Vectors on a grid that half floats hold, written as a cache, checked, and read back by key.

    The second write without `overwrite` has to be refused.
    """
    path = f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    grid = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64) / 64)
    slots, dim = SHAPE
    matrix = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.slice(grid, i * dim + 1, F.lit(dim)))
    episode = (F.col("vec_id") / 100).cast("long")
    frame = F.col("vec_id") % 100
    rows = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.lit("train").alias("split"),
        F.lit(0).cast("long").alias("dataset_index"),
        F.lit("vectors").alias("repo_id"),
        F.lit("/").alias("root"),
        F.lit("embedding").alias("camera_key"),
        episode.alias("episode_index"),
        frame.alias("frame_index"),
        F.col("vec_id").alias("absolute_index"),
        (frame / 10).alias("timestamp"),
        F.col("label").cast("long").alias("task_index"),
        F.array("vec_id").alias("context_absolute_indices"),
        F.array(frame).alias("context_frame_indices"),
        F.array(F.lit(False)).alias("context_is_pad"),
        matrix.alias("features"),
    )
    total = rows.count()
    write_cache(rows, path, SHAPE, total, target_mb=0.0625)
    try:
        write_cache(rows, path, SHAPE, total, target_mb=0.0625)
        second = "accepted"
    except FileExistsError:
        second = "refused"
    cache = FeatureCache(spark, path)
    asked = rows.select(F.col("row_id").alias("position"), "dataset_index", "episode_index", "frame_index")
    found = cache.get_many(cache.lookup(asked).select("position", "row_id"))
    shards = stored_shards(spark, path).select("shard_path", "stored_bytes")
    described = found.join(cache.index.select("row_id", "shard_path"), "row_id").join(shards, "shard_path")
    return described.select(
        "row_id",
        "shard_path",
        micros(F.flatten("features").cast("array<double>")).alias("features"),
        "stored_bytes",
        F.lit(cache.metadata["complete"]).alias("complete"),
        F.lit(cache.metadata["num_rows"]).cast("long").alias("num_rows"),
        F.lit(second).alias("second_write"),
    )


@query(
    "feature_stats",
    f"""SELECT vec_id AS row_id, {s6('list_min(e)')} AS min_value, {s6('list_max(e)')} AS max_value, {s6('list_avg(e)')} AS mean_value,
    {s6('list_stddev_pop(e)')} AS std_value, {smicros('e[1:8]')} AS first_values
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""",
)
def feature_stats(spark, sf):
    stats = ops.feature_stats(vectors(spark, sf), "features", ["row_id"])
    return stats.select(
        "row_id",
        *[r6(F.col(c)).alias(c) for c in ("min_value", "max_value", "mean_value", "std_value")],
        micros("first_values").alias("first_values"),
    )


@query(
    "lookup_unique_key",
    """WITH idx AS (SELECT l_orderkey AS episode, l_linenumber AS frame, count(*) AS copies, min(l_partkey) AS row_id
      FROM lineitem GROUP BY ALL),
    req AS (SELECT o_orderkey AS episode, unnest([1, 2, 3]) AS frame FROM orders)
    SELECT r.episode, r.frame, CASE WHEN i.copies IS NULL THEN 'missing' WHEN i.copies > 1 THEN 'ambiguous' ELSE 'found' END AS status,
    CASE WHEN i.copies = 1 THEN i.row_id ELSE -1 END AS row_id
    FROM req r LEFT JOIN idx i ON i.episode = r.episode AND i.frame = r.frame""",
)
def lookup_unique_key(spark, sf):
    """Order lines are the index; (order, line) is often repeated, so it is ambiguous."""
    index = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("frame"), F.col("l_partkey").alias("row_id")
    )
    requests = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("episode"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("frame")
    )
    found = lookup.lookup_unique_key(requests, index, ["episode", "frame"])
    return found.withColumn("row_id", F.coalesce("row_id", F.lit(-1).cast("long")))


@query(
    "multi_get_ordered",
    """SELECT e.event_id AS position, vec_id AS row_id, label::BIGINT AS label, """
    + smicros("list_transform(embedding, lambda x: x::DOUBLE)")
    + """ AS vector FROM events e JOIN embeddings v ON v.vec_id = (e.user_id * 7) % (SELECT count(*) FROM embeddings)""",
)
def multi_get_ordered(spark, sf):
    """Every event asks for a vector by id; ids repeat, positions keep the request order."""
    n = vector_count(spark, sf)
    requests = v.table(spark, sf, "events").select(
        F.col("event_id").alias("position"), F.pmod(F.col("user_id") * 7, n).alias("row_id")
    )
    vecs = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("long").alias("label"),
        micros(F.col("embedding").cast("array<double>")).alias("vector"),
    )
    return lookup.multi_get(requests, vecs, "row_id").select("position", "row_id", "label", "vector")


@query(
    "load_records_by_id",
    """SELECT l_orderkey * 10 + l_linenumber AS position, l_partkey AS id, p_name AS name, p_brand AS category
    FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def load_records_by_id(spark, sf):
    requests = v.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_partkey").alias("id")
    )
    records = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category")
    )
    return lookup.multi_get(requests, records, "id").select("position", "id", "name", "category")


@query(
    "predict_features",
    v.with_views(
        "patches",
        extra={"frames": "SELECT video, frame, list(list_avg(feature) ORDER BY patch) AS m FROM patches GROUP BY ALL"},
    )
    + f"SELECT video AS episode_index, frame AS frame_index, {smicros('m')} AS features FROM frames",
)
def predict_features(spark, sf):
    """A batch predictor that averages each patch; one row per frame window."""
    windows = v.patches(spark, sf).groupBy(
        F.col("video").alias("episode_index"), F.col("frame").alias("frame_index")
    ).agg(F.sort_array(F.collect_list(F.struct("patch", as_doubles("feature").alias("f")))).alias("rows"))
    windows = windows.select("episode_index", "frame_index", F.col("rows.f").alias("patches"))

    def patch_means(batch: pd.DataFrame):
        # a frame may have fewer patches than the grid
        return [[np.mean(p) for p in patches] for patches in batch["patches"]]

    out = predict(windows, patch_means, T.ArrayType(T.DoubleType()), ("episode_index", "frame_index"))
    return out.select("episode_index", "frame_index", micros("features").alias("features"))


@query(
    "map_columns_udf",
    """SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS p_size, upper(p_name) AS p_name FROM part""",
)
def map_columns_udf(spark, sf):
    parts = v.table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    return map_columns(
        parts,
        {
            "p_size": (lambda s: s * 2 + 1, T.LongType()),
            "p_name": (lambda s: s.str.upper(), T.StringType()),
        },
    )
