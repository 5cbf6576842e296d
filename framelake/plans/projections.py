"""Queries over column selection and small filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.integers import div
from ..functions.nested import json_path, read_path
from ..operators import projections as ops
from ..operators.numbering import dense_index, int_bucket
from ..operators.sampling import pad_to_size, remove_padding as drop_padding
from . import views as v
from .registry import micros, query, r6, s6, smicros


@query(
    "select_by_prefix",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, o_orderkey AS _row FROM orders JOIN customer ON o_custkey = c_custkey",
)
def select_by_prefix(spark, sf):
    joined_rows = v.table(spark, sf, "orders").join(
        v.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return ops.select_by_prefix(joined_rows.withColumn("_row", F.col("o_orderkey")), ["c_"])


@query("strip_extensions", "SELECT doc_id, text, lang, n_chars FROM documents")
def strip_extensions(spark, sf):
    members = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc_id"),
        F.col("text").alias("text.txt"),
        F.col("lang").alias("lang.cls"),
        F.col("n_chars").alias("n_chars.meta.json"),
    )
    return ops.strip_extensions(members)


@query("rename_columns", "SELECT s_suppkey AS video_id, s_name AS name, s_nationkey, s_acctbal AS weight FROM supplier")
def rename_columns(spark, sf):
    return ops.rename_columns(
        v.table(spark, sf, "supplier"), {"s_suppkey": "video_id", "s_name": "name", "s_acctbal": "weight"}
    )


@query("duplicate_columns", "SELECT p_partkey, p_size, p_size AS size_copy, p_name, p_name AS name_copy FROM part")
def duplicate_columns(spark, sf):
    parts = v.table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    return ops.duplicate_columns(parts, {"p_size": "size_copy", "p_name": "name_copy"})


@query(
    "read_nested_path",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS json_k, value AS nested_value,
    event_type AS first_tag, 'none' AS absent FROM events""",
)
def read_nested_path(spark, sf):
    events = v.table(spark, sf, "events").select(
        "event_id",
        "props",
        F.struct(F.struct(F.col("value").alias("b"), F.array("event_type").alias("tags")).alias("a")).alias("root"),
    )
    return events.select(
        "event_id",
        json_path("props", "k").cast("long").alias("json_k"),
        read_path(events.schema, "root.a.b").alias("nested_value"),
        read_path(events.schema, "root.a.tags.0").alias("first_tag"),
        F.coalesce(read_path(events.schema, "root.a.missing", strict=False), F.lit("none")).alias("absent"),
    )


@query(
    "project_cast",
    """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS l_quantity,
    CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS l_extendedprice FROM lineitem""",
)
def project_cast(spark, sf):
    cast = ops.project_cast(
        v.table(spark, sf, "lineitem"),
        {"l_orderkey": None, "l_partkey": None, "l_suppkey": None, "l_quantity": "int", "l_extendedprice": "float"},
    )
    return cast.withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))


@query(
    "slice_vector",
    v.with_views("patches") + f"SELECT video, frame, patch, {smicros('feature[5:12]')} AS part FROM patches",
)
def slice_vector(spark, sf):
    start, stop = ops.resolve_slice(64, 8, configured=(4, 12))
    sliced = ops.slice_vector(v.patches(spark, sf), "feature", start, stop)
    return sliced.select("video", "frame", "patch", micros(F.col("feature").cast("array<double>")).alias("part"))


@query(
    "drop_last_frames",
    v.with_views("patches")
    + """SELECT video, frame, patch FROM patches p
    WHERE frame < (SELECT max(frame) FROM patches q WHERE q.video = p.video) + 1 - 2""",
)
def drop_last_frames(spark, sf):
    return ops.drop_last_frames(v.patches(spark, sf), 2, ["video"]).select("video", "frame", "patch")


@query(
    "last_step_features",
    v.with_views("patches")
    + f"""SELECT video, patch, max(frame) AS last_frame, {smicros('max_by(feature, frame)')} AS feature
    FROM patches GROUP BY video, patch""",
)
def last_step_features(spark, sf):
    last = ops.last_step(v.patches(spark, sf), ["video", "patch"], "feature")
    return last.select(
        "video", "patch", "last_frame", micros(F.col("feature").cast("array<double>")).alias("feature")
    )


def padded_samples(spark, sf):
    """Labelled documents dealt to 8 workers and padded to the longest slice."""
    labels = dense_index(v.table(spark, sf, "labels"), ["doc_id"], int_bucket("doc_id"))
    dealt = labels.select(
        F.col("doc_id").cast("string").alias("key"), "quality", F.pmod("row_id", F.lit(8)).alias("worker")
    )
    size = v.table(spark, sf, "labels").agg(div(F.count(F.lit(1)) + 7, 8) + 2).scalar()
    return pad_to_size(dealt, size)


PADDED = """labelled AS (SELECT CAST(doc_id AS VARCHAR) AS key, quality,
      (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS worker FROM labels),
    need AS (SELECT w.worker, (SELECT (count(*) + 7) // 8 + 2 FROM labels) - count(l.key) AS n
      FROM (SELECT DISTINCT worker FROM labelled) w LEFT JOIN labelled l USING (worker) GROUP BY 1)"""


@query(
    "pad_to_size",
    f"""WITH {PADDED} SELECT worker, key, quality, false AS batch_padding_mask FROM labelled
    UNION ALL SELECT worker, 'PADDING', 0, true FROM (SELECT *, unnest(range(n)) FROM need)""",
)
def pad_query(spark, sf):
    return padded_samples(spark, sf)


@query("remove_padding", f"WITH {PADDED} SELECT worker, key, quality FROM labelled")
def remove_padding(spark, sf):
    return drop_padding(padded_samples(spark, sf))


@query(
    "l2_normalize",
    v.with_views(
        "patches",
        extra={"norms": "SELECT *, greatest(sqrt(list_sum(list_transform(feature, lambda x: x * x))), 1e-12) AS norm FROM patches"},
    )
    + f"SELECT video, frame, patch, {s6('norm')} AS norm, {smicros('list_transform(feature, lambda x: x / norm)')} AS unit FROM norms",
)
def l2_normalize(spark, sf):
    from ..functions import vectors

    return v.patches(spark, sf).select(
        "video",
        "frame",
        "patch",
        r6(vectors.l2_norm("feature")).alias("norm"),
        micros(vectors.l2_normalize("feature")).alias("unit"),
    )
