"""Queries over annotation tables and run-length masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.integers import div
from ..operators import annotations as ops
from ..operators.numbering import int_bucket
from . import views as v
from .registry import query, r6, s6


@query(
    "annotations_filter",
    v.with_views("annotations")
    + """SELECT id, video_id, category_id, avg_area FROM annotations
    WHERE category_id IN ('click', 'purchase') AND avg_area > 5 AND avg_area < 60 AND iscrowd = 0""",
)
def annotations_filter(spark, sf):
    kept = ops.annotations_filter(
        v.annotations(spark, sf), category_ids=["click", "purchase"], area_range=(5.0, 60.0), iscrowd=False
    )
    return kept.select("id", "video_id", "category_id", "avg_area")


@query(
    "categories_filter",
    "SELECT p_partkey AS id, p_brand AS name, p_type AS supercategory FROM part WHERE p_brand IN ('Brand#2', 'Brand#17', 'Brand#5') AND p_type IN ('ECONOMY', 'PROMO')",
)
def categories_filter(spark, sf):
    categories = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("supercategory")
    )
    return ops.categories_filter(categories, ["Brand#2", "Brand#17", "Brand#5"], ["ECONOMY", "PROMO"])


@query(
    "videos_with_all_categories",
    """SELECT l_orderkey AS video_id FROM lineitem WHERE l_returnflag IN ('A', 'R')
    GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2""",
)
def videos_with_all_categories(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_returnflag").alias("category_id")
    )
    return ops.videos_with_all_categories(lines, ["A", "R"])


@query(
    "expand_video_annotations",
    """WITH videos AS (SELECT o_orderkey AS video_id, length(o_orderpriority) // 4 AS length FROM orders),
    ann AS (SELECT DISTINCT l_orderkey AS video_id, l_orderkey * 10 + l_linenumber AS annotation_id, l_linenumber AS category_id FROM lineitem),
    seg AS (SELECT l_orderkey * 10 + l_linenumber AS annotation_id, l_suppkey % 3 AS frame_index, max(l_quantity) AS area FROM lineitem GROUP BY ALL),
    num AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY annotation_id) - 1 AS instance FROM ann),
    grid AS (SELECT v.video_id, f.i AS frame_index, n.instance, n.annotation_id, n.category_id
      FROM videos v CROSS JOIN LATERAL (SELECT unnest(range(v.length)) AS i) f LEFT JOIN num n USING (video_id))
    SELECT g.video_id, g.frame_index, coalesce(instance, 0) AS instance, coalesce(g.annotation_id, -1) AS annotation_id,
    coalesce(category_id, -1)::BIGINT AS category_id, coalesce(s.area, 0::DOUBLE) AS area, s.area IS NULL AS is_empty
    FROM grid g LEFT JOIN seg s ON s.annotation_id = g.annotation_id AND s.frame_index = g.frame_index""",
)
def expand_video_annotations(spark, sf):
    """Orders as videos, (order, line) as instances, lines as their segments."""
    lines = v.table(spark, sf, "lineitem")
    annotation = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("annotation_id")
    videos = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"),
        div(F.length("o_orderpriority"), 4).alias("length"),
    )
    instances = lines.select(
        F.col("l_orderkey").alias("video_id"),
        annotation.alias("id"),
        F.col("l_linenumber").cast("long").alias("category_id"),
    ).distinct()
    segments = lines.groupBy(annotation, F.pmod("l_suppkey", F.lit(3)).alias("frame_index")).agg(
        F.max("l_quantity").alias("area")
    )
    return ops.expand_video_annotations(videos, instances, segments)


@query(
    "results_anti_check",
    """SELECT video_id, count(*) AS n_results FROM (SELECT user_id AS video_id FROM events)
    WHERE video_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
)
def results_anti_check(spark, sf):
    """Event users as result videos against suppliers as ground truth."""
    results = v.table(spark, sf, "events").select(F.col("user_id").alias("video_id"))
    videos = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("video_id"))
    return ops.results_without_video(results, videos).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_results"))


@query(
    "annotation_avg_area",
    f"""SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey,
    {s6("CASE WHEN n > 0 THEN s / n ELSE 0 END")} AS avg_area, 0::BIGINT AS iscrowd
    FROM (SELECT o_orderkey, count(l.l_quantity) FILTER (l.l_linestatus = 'O' AND l.l_quantity <> 0) AS n,
      coalesce(sum(l.l_quantity) FILTER (l.l_linestatus = 'O'), 0) AS s
      FROM orders LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey GROUP BY 1)""",
)
def annotation_avg_area(spark, sf):
    """Orders as results, their lines as segments; finished lines are segments without a mask."""
    segments = v.table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("area")
    )
    areas = ops.segment_areas(segments, "l_orderkey")
    results = (
        v.table(spark, sf, "orders")
        .select("o_orderkey")
        .join(areas, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select("o_orderkey", F.coalesce("avg_area", F.lit(0.0)).alias("avg_area"))
    )
    enriched = ops.enrich_results(results, ["o_orderkey"], int_bucket("o_orderkey"))
    return enriched.select("id", "o_orderkey", r6(F.col("avg_area")).alias("avg_area"), "iscrowd")


@query(
    "max_instances",
    """SELECT o_orderpriority AS split, max(n) AS max_instances FROM (
      SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def max_instances(spark, sf):
    per_video = v.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    videos = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("split"))
    return (
        per_video.join(videos, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("split")
        .agg(F.max("n").alias("max_instances"))
    )


# One run-length mask per part: its name's characters code the runs.
RLE_SQL = """runs AS (SELECT p_partkey AS id,
      list_transform(range(1, length(p_name) + 1), lambda i: CAST(ascii(substr(p_name, i, 1)) % 7 AS BIGINT)) AS counts FROM part)"""


def run_length_masks(spark, sf):
    letters = F.transform(
        F.sequence(F.lit(1), F.length("p_name")),
        lambda i: F.pmod(F.ascii(F.substring(F.col("p_name"), i, F.lit(1))), F.lit(7)).cast("long"),
    )
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), letters.alias("counts"))


@query(
    "rle_area",
    f"""WITH {RLE_SQL} SELECT id,
    CAST(coalesce(list_sum(list_filter(counts, lambda c, i: i % 2 = 0)), 0) AS BIGINT) AS area, CAST(list_sum(counts) AS BIGINT) AS n_pixels FROM runs""",
)
def rle_area(spark, sf):
    return run_length_masks(spark, sf).select(
        "id", ops.rle_area(F.col("counts")).alias("area"), ops.rle_total(F.col("counts")).alias("n_pixels")
    )


@query(
    "rle_decode",
    f"""WITH {RLE_SQL},
    e AS (SELECT id, unnest(counts) AS c, generate_subscripts(counts, 1) AS i FROM runs),
    b AS (SELECT id, c, i, sum(c) OVER (PARTITION BY id ORDER BY i) - c AS start FROM e)
    SELECT id, CAST((start + k) % 6 AS BIGINT) AS y, CAST((start + k) // 6 AS BIGINT) AS x
    FROM b JOIN range(10) r(k) ON r.k < c WHERE i % 2 = 0""",
)
def rle_decode(spark, sf):
    return ops.rle_decode(run_length_masks(spark, sf), ["id"], F.lit(6))


RLE_PIXELS = """e AS (SELECT id, unnest({counts}) AS c, generate_subscripts({counts}, 1) AS i FROM {masks}),
    b AS (SELECT id, c, i, sum(c) OVER (PARTITION BY id ORDER BY i) - c AS start FROM e),
    p AS (SELECT id, CAST(start + k AS BIGINT) AS pixel FROM b JOIN range(10) r(k) ON r.k < c WHERE i % 2 = 0)"""


@query(
    "rle_boxes",
    f"""WITH {RLE_SQL}, {RLE_PIXELS.format(counts="counts", masks="runs")}
    SELECT runs.id, CAST(coalesce(min(pixel // 6), 0) AS BIGINT) AS x, CAST(coalesce(min(pixel % 6), 0) AS BIGINT) AS y,
    CAST(coalesce(max(pixel // 6) - min(pixel // 6) + 1, 0) AS BIGINT) AS width,
    CAST(coalesce(max(pixel % 6) - min(pixel % 6) + 1, 0) AS BIGINT) AS height, count(pixel) AS area
    FROM runs LEFT JOIN p ON p.id = runs.id GROUP BY runs.id""",
)
def rle_boxes(spark, sf):
    return ops.rle_boxes(run_length_masks(spark, sf), ["id"], F.lit(6))


@query(
    "rle_overlap",
    f"""WITH {RLE_SQL}, one AS (WITH {RLE_PIXELS.format(counts="counts", masks="runs")} SELECT * FROM p),
    other AS (WITH {RLE_PIXELS.format(counts="list_reverse(counts)", masks="runs")} SELECT * FROM p)
    SELECT runs.id, count(one.pixel) FILTER (one.pixel IS NOT NULL AND other.pixel IS NOT NULL) AS intersection,
    count(coalesce(one.pixel, other.pixel)) AS "union"
    FROM runs LEFT JOIN (one FULL JOIN other ON one.id = other.id AND one.pixel = other.pixel) ON coalesce(one.id, other.id) = runs.id
    GROUP BY runs.id""",
)
def rle_overlap(spark, sf):
    """Each mask against the one with its runs in reverse, without pixels."""
    masks = run_length_masks(spark, sf)
    shared = masks.select("id", ops.rle_overlap("counts", F.reverse("counts")).alias("o"))
    return shared.select("id", F.col("o.intersection").alias("intersection"), F.col("o.union").alias("union"))
