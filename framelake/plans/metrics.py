"""Queries over masks and segmentation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import as_doubles
from ..operators import label_frames, masks, metrics as ops
from . import views as v
from .registry import joined, query, r6, s6

FRAME, VIDEO = ["video", "frame"], ["video"]
POINT = ["y", "x"]


def conf_sql(sample: str, true: str = "true_mask", pred: str = "pred_mask", point: str = "video, frame, y, x") -> dict[str, str]:
    """Confusion rows in SQL: cells, class totals, and tp / fp / fn."""
    return {
        "cells": f"SELECT {sample}, t.class AS true_class, p.class AS pred_class, count(*) AS n FROM {true} t JOIN {pred} p USING ({point}) GROUP BY ALL",
        "nt": f"SELECT {sample}, class AS true_class, count(*) AS n_true FROM {true} GROUP BY ALL",
        "np": f"SELECT {sample}, class AS pred_class, count(*) AS n_pred FROM {pred} GROUP BY ALL",
        "conf": f"""SELECT {sample}, true_class, pred_class, n AS tp, n_pred - n AS fp, n_true - n AS fn,
          n / (n_true + n_pred - n)::DOUBLE AS iou, n / n_pred::DOUBLE AS prec, n / n_true::DOUBLE AS rec
          FROM cells JOIN nt USING ({sample}, true_class) JOIN np USING ({sample}, pred_class)""",
    }


def ari_sql(sample: str, where: str = "true") -> dict[str, str]:
    return {
        "scored": f"SELECT DISTINCT {sample} FROM true_mask",
        "c": f"""SELECT {sample}, t.class AS a, p.class AS b, count(*)::DOUBLE AS n FROM true_mask t JOIN pred_mask p
          USING (video, frame, y, x) WHERE {where} GROUP BY ALL""",
        "ra": f"SELECT {sample}, sum(n) AS n FROM c GROUP BY {sample}, a",
        "rb": f"SELECT {sample}, sum(n) AS n FROM c GROUP BY {sample}, b",
        "i": f"SELECT {sample}, sum(n * (n - 1)) AS ri, sum(n) AS pts FROM c GROUP BY {sample}",
        "ia": f"SELECT {sample}, sum(n * (n - 1)) AS ai FROM ra GROUP BY {sample}",
        "ib": f"SELECT {sample}, sum(n * (n - 1)) AS bi FROM rb GROUP BY {sample}",
        "e": f"""SELECT {sample}, coalesce(ri, 0) AS ri, coalesce(ai, 0) AS ai, coalesce(bi, 0) AS bi,
          coalesce(ai, 0) * coalesce(bi, 0) / greatest(coalesce(pts, 0) * (coalesce(pts, 0) - 1), 1) AS ex
          FROM scored LEFT JOIN i USING ({sample}) LEFT JOIN ia USING ({sample}) LEFT JOIN ib USING ({sample})""",
        "ari": f"SELECT {sample}, CASE WHEN (ai + bi) / 2 - ex <> 0 THEN (ri - ex) / ((ai + bi) / 2 - ex) ELSE 1.0 END AS ari FROM e",
    }


MASKS = ("true_mask", "pred_mask")


def both(spark, sf):
    """Pixel rows of the two masks."""
    return v.true_mask(spark, sf), v.pred_mask(spark, sf)


def cells(spark, sf, sample, **options):
    """Class-pair counts of the packed masks."""
    return label_frames.class_cells(v.label_frames(spark, sf), FRAME, sample, **options)


@query(
    "soft_to_hard_mask",
    v.with_views("patches", "hard_mask")
    + """, thr AS (SELECT video, frame, y, x, list_transform(feature, lambda s: CASE WHEN (s + 1.0) / 2.0 > 0.55 THEN 1 ELSE 0 END) AS h FROM patches)
    SELECT video, frame, y, x, p.class AS hard_class, CAST(list_position(h, list_max(h)) - 1 AS BIGINT) AS threshold_class
    FROM hard_mask p JOIN thr USING (video, frame, y, x)""",
)
def soft_to_hard_mask(spark, sf):
    """Hard class with and without a threshold, from slots kept in one array."""
    soft = v.patches(spark, sf).select("video", "frame", *v.grid_yx(), v.soft_values().alias("soft"))
    return soft.select(
        "video",
        "frame",
        "y",
        "x",
        masks.soft_array_to_hard(F.col("soft")).alias("hard_class"),
        masks.soft_array_to_hard(F.col("soft"), 0.55).alias("threshold_class"),
    )


@query(
    "soft_to_hard_long",
    v.with_views("hard_mask") + "SELECT video, frame, y, x, class FROM hard_mask",
)
def soft_to_hard_long(spark, sf):
    """The same from a long table with one row per slot."""
    soft = v.patches(spark, sf).select(
        "video", "frame", *v.grid_yx(), F.posexplode(v.soft_values()).alias("slot", "value")
    )
    return masks.soft_to_hard(soft, ["video", "frame", "y", "x"], n_slots=v.SLOTS)


@query(
    "dense_to_onehot",
    v.with_views("patches")
    + """SELECT video, frame, y, x, label - 1 AS class,
    array_to_string(list_transform(range(0, 10), lambda c: CASE WHEN c = label THEN 1 ELSE 0 END), ',') AS onehot FROM patches WHERE label > 0""",
)
def dense_to_onehot(spark, sf):
    labels = v.patches(spark, sf).select("video", "frame", *v.grid_yx(), "label")
    wide = labels.withColumn("onehot", joined(masks.onehot_array(F.col("label"), 10).cast("array<int>")))
    return masks.dense_to_onehot(wide, remove_zero=True).drop("label")


@query(
    "instances_to_binary",
    v.with_views("patches")
    + """SELECT video, frame, y, x, array_to_string(list_concat(list_transform(feature, lambda f: CASE WHEN floor(f * 8) <> 0 THEN 1 ELSE 0 END), [0, 0]), ',') AS binary_mask FROM patches""",
)
def instances_to_binary(spark, sf):
    stack = F.transform(as_doubles("feature"), lambda f: F.floor(f * 8))
    return v.patches(spark, sf).select(
        "video",
        "frame",
        *v.grid_yx(),
        joined(masks.instances_to_binary(stack, 66).cast("array<int>")).alias("binary_mask"),
    )


@query(
    "mask_validation",
    v.with_views("overlapping_mask", "pred_mask")
    + """, t AS (SELECT video, frame, y, x, count(*) AS n FROM overlapping_mask GROUP BY ALL)
    SELECT video, frame, count(*) AS n_points, 0::BIGINT AS true_not_binary, 0::BIGINT AS pred_not_binary, 0::BIGINT AS pred_not_onehot,
    count(*) FILTER (t.n > 1) AS true_overlaps, count(*) FILTER (t.n <> 1) AS true_not_onehot, count(*) FILTER (t.n > 1) = 0 AS ok
    FROM t JOIN pred_mask USING (video, frame, y, x) GROUP BY video, frame""",
)
def mask_validation(spark, sf):
    return masks.mask_validation(v.overlapping_mask(spark, sf), v.pred_mask(spark, sf), FRAME, POINT)


@query(
    "mask_overlap_removal",
    v.with_views("overlapping_mask", "pred_mask")
    + """, o AS (SELECT video, frame, y, x FROM overlapping_mask GROUP BY ALL HAVING count(*) > 1)
    SELECT 'true' AS side, video, frame, y, x, class FROM overlapping_mask ANTI JOIN o USING (video, frame, y, x) WHERE class <> 0
    UNION ALL SELECT 'pred', video, frame, y, x, class FROM pred_mask ANTI JOIN o USING (video, frame, y, x)""",
)
def mask_overlap_removal(spark, sf):
    true, pred = masks.drop_overlaps(
        v.overlapping_mask(spark, sf), v.pred_mask(spark, sf), [*FRAME, *POINT], from_pred=True
    )
    kept = masks.drop_background(true).withColumn("side", F.lit("true"))
    return kept.unionByName(pred.withColumn("side", F.lit("pred")))


@query(
    "contingency_counts",
    v.with_views(*MASKS, extra=conf_sql("video, frame")) + "SELECT video, frame, true_class, pred_class, n FROM cells",
)
def contingency_counts(spark, sf):
    return ops.contingency(*both(spark, sf), FRAME, POINT)


@query(
    "mask_confusion",
    v.with_views(*MASKS, extra=conf_sql("video, frame"))
    + "SELECT video, frame, true_class, pred_class, tp, fp, fn FROM conf",
)
def mask_confusion(spark, sf):
    """From pixel rows, as `contingency_counts` is."""
    return ops.confusion(*both(spark, sf), FRAME, POINT)


@query(
    "ari_per_sample",
    v.with_views(*MASKS, extra=ari_sql("video, frame")) + f"SELECT video, frame, {s6('ari')} AS ari FROM ari",
)
def ari_per_sample(spark, sf):
    return ops.adjusted_rand_index_of(cells(spark, sf, FRAME), FRAME).withColumn("ari", r6(F.col("ari")))


def report(scores, value):
    state = ops.merge_states(ops.metric_state(scores, value))
    return state.select(r6(F.col("value")).alias(value), F.col("value_count").alias("n_samples"))


@query(
    "image_ari",
    v.with_views(*MASKS, extra=ari_sql("video, frame")) + f"SELECT {s6('avg(ari)')} AS ari, count(*) AS n_samples FROM ari",
)
def image_ari(spark, sf):
    return report(ops.adjusted_rand_index_of(cells(spark, sf, FRAME), FRAME), "ari")


@query(
    "video_ari",
    v.with_views(*MASKS, extra=ari_sql("video")) + f"SELECT {s6('avg(ari)')} AS ari, count(*) AS n_samples FROM ari",
)
def video_ari(spark, sf):
    return report(ops.adjusted_rand_index_of(cells(spark, sf, VIDEO), VIDEO), "ari")


@query(
    "fg_ari",
    v.with_views(*MASKS, extra=ari_sql("video", "t.class <> 0")) + f"SELECT video, {s6('ari')} AS ari FROM ari",
)
def fg_ari(spark, sf):
    """Foreground ARI over all frames of a video."""
    scores = ops.adjusted_rand_index_of(cells(spark, sf, VIDEO, ignore_background=True), VIDEO, ignore_background=True)
    return scores.withColumn("ari", r6(F.col("ari")))


@query(
    "pairwise_iou",
    v.with_views(*MASKS, extra=conf_sql("video, frame"))
    + f"SELECT video, frame, true_class, pred_class, {s6('iou')} AS iou FROM conf",
)
def pairwise_iou(spark, sf):
    ious = ops.pairwise_iou(ops.confusion_of(cells(spark, sf, FRAME), FRAME))
    return ious.select(*FRAME, "true_class", "pred_class", r6(F.col("iou")).alias("iou"))


@query(
    "iou_match_none",
    v.with_views(*MASKS, extra=conf_sql("video, frame"))
    + f"""SELECT video, frame, true_class, {s6('coalesce(iou, 0)')} AS iou FROM nt
    LEFT JOIN (SELECT * FROM conf WHERE true_class = pred_class) USING (video, frame, true_class)""",
)
def iou_match_none(spark, sf):
    ious = ops.matched_iou_of(cells(spark, sf, FRAME), FRAME, "none")
    return ious.withColumn("iou", r6(F.col("iou")))


def mean_of_best(sample: str) -> str:
    return f"""SELECT {s6('avg(m)')} AS mean_iou, count(*) AS n_samples FROM (
      SELECT {sample}, avg(coalesce(best, 0)) AS m FROM nt LEFT JOIN (
        SELECT {sample}, true_class, max(iou) AS best FROM conf GROUP BY ALL) USING ({sample}, true_class) GROUP BY {sample})"""


@query("image_mbo", v.with_views(*MASKS, extra=conf_sql("video, frame")) + mean_of_best("video, frame"))
def image_mbo(spark, sf):
    return report(ops.mean_iou_of(cells(spark, sf, FRAME), FRAME), "mean_iou")


@query("video_mbo", v.with_views(*MASKS, extra=conf_sql("video")) + mean_of_best("video"))
def video_mbo(spark, sf):
    return report(ops.mean_iou_of(cells(spark, sf, VIDEO), VIDEO), "mean_iou")


CLEAN = {
    "o": "SELECT video, frame, y, x FROM overlapping_mask GROUP BY ALL HAVING count(*) > 1",
    "kept_true": "SELECT * FROM overlapping_mask ANTI JOIN o USING (video, frame, y, x) WHERE class <> 0",
    "kept_pred": "SELECT * FROM pred_mask ANTI JOIN o USING (video, frame, y, x)",
}


@query(
    "mean_iou",
    v.with_views("overlapping_mask", "pred_mask", extra={**CLEAN, **conf_sql("video", "kept_true", "kept_pred")})
    + f"""SELECT video, count(*) AS n_classes, {s6('avg(coalesce(best, 0))')} AS mean_iou FROM nt LEFT JOIN (
      SELECT video, true_class, max(iou) AS best FROM conf GROUP BY ALL) USING (video, true_class) GROUP BY video""",
)
def mean_iou(spark, sf):
    """Overlapping points and the background are ignored."""
    counts = cells(
        spark, sf, VIDEO, true="overlapping", ignore_overlaps=True, ignore_background=True, overlaps_leave_pred=True
    )
    scores = ops.mean_iou_of(counts, VIDEO, ignore_background=True)
    return scores.withColumn("mean_iou", r6(F.col("mean_iou")))


def assignment_sql(source: str, score: str, keys: str, n_true: int, n_pred: int, also: tuple[str, ...] = ()) -> dict[str, str]:
    """Best one-to-one total by dynamic programming over sets of used predictions; also: sums over the best pairs."""
    zeros = "".join(f", 0.0::DOUBLE AS {c}" for c in also)
    best, kept, added = ("".join(form.format(c=c) for c in also) for form in (", arg_max({c}, total) AS {c}", ", {c}", ", d.{c} + s.{c} AS {c}"))
    views = {
        "dp0": f"SELECT {keys}, 0 AS used, 0.0::DOUBLE AS total{zeros} FROM (SELECT DISTINCT {keys} FROM {source})",
    }
    for c in range(n_true):
        views[f"dp{c + 1}"] = f"""SELECT {keys}, used, max(total) AS total{best} FROM (
          SELECT {keys}, used, total{kept} FROM dp{c}
          UNION ALL SELECT {keys}, d.used | (1 << s.pred_class::INT), d.total + s.{score}{added}
          FROM dp{c} d JOIN {source} s USING ({keys}) WHERE s.true_class = {c} AND d.used & (1 << s.pred_class::INT) = 0)
          GROUP BY ALL"""
    views["best"] = f"SELECT {keys}, max(total) AS total{best} FROM dp{n_true} GROUP BY {keys}"
    return views


@query(
    "iou_match_optimal",
    v.with_views(*MASKS, extra={**conf_sql("video, frame"), **assignment_sql("conf", "iou", "video, frame", 10, 8)})
    + f"""SELECT video, frame, count(*) AS n_classes, {s6('max(coalesce(total, 0)) / count(*)')} AS mean_iou
    FROM nt LEFT JOIN best USING (video, frame) GROUP BY video, frame""",
)
def iou_match_optimal(spark, sf):
    scores = ops.mean_iou_of(cells(spark, sf, FRAME), FRAME, "optimal")
    return scores.withColumn("mean_iou", r6(F.col("mean_iou")))


@query(
    "pairwise_f_measure",
    v.with_views(*MASKS, extra=conf_sql("video, frame"))
    + f"""SELECT video, frame, true_class, pred_class, {s6('prec')} AS precision, {s6('rec')} AS recall,
    {s6('2 * prec * rec / (prec + rec)')} AS f_measure FROM conf""",
)
def pairwise_f_measure(spark, sf):
    scored = ops.pairwise_f_measure(ops.confusion_of(cells(spark, sf, FRAME), FRAME))
    return scored.select(
        *FRAME, "true_class", "pred_class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f_measure")]
    )


def boundary_sql(mask: str) -> str:
    """Pixels without a full 3x3 neighbourhood of their class; the image border counts as outside."""
    return f"""SELECT m.video, m.frame, m.y, m.x, m.class FROM {mask} m JOIN {mask} n
      ON n.video = m.video AND n.frame = m.frame AND n.class = m.class AND n.y BETWEEN m.y - 1 AND m.y + 1 AND n.x BETWEEN m.x - 1 AND m.x + 1
      GROUP BY ALL HAVING count(*) < 9"""


EDGES = {"edge_true": boundary_sql("true_mask"), "edge_pred": boundary_sql("pred_mask")}


@query(
    "synthetic_squares",
    v.with_views("square_true")
    + """SELECT video, frame, class AS label, count(*) AS n_pixels, CASE WHEN class > 0 THEN 0 ELSE 255 END::BIGINT AS value
    FROM square_true GROUP BY ALL""",
)
def synthetic_squares(spark, sf):
    """Pixels per instance of one generated image per supplier."""
    return v.square_masks(spark, sf).groupBy("video", "frame", "label").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.max("value").cast("long").alias("value")
    )


@query(
    "mask_boundaries",
    v.with_views("true_mask", extra={"edge_true": EDGES["edge_true"]})
    + "SELECT video, frame, y, x, class FROM edge_true",
)
def mask_boundaries(spark, sf):
    """Boundaries of packed masks, unpacked to their pixels."""
    edges = label_frames.mask_boundaries(v.label_frames(spark, sf), FRAME, "true", v.GRID_H, v.GRID_W)
    return label_frames.pixels(edges, FRAME, "true", v.GRID_W)


@query(
    "square_boundaries",
    v.with_views("square_true", extra={"edge_true": boundary_sql("square_true")})
    + "SELECT video, frame, y, x, class FROM edge_true",
)
def square_boundaries(spark, sf):
    """Boundaries of pixel rows, of one generated image per supplier."""
    squares = v.square_masks(spark, sf).select("video", "frame", "y", "x", F.col("label").alias("class"))
    return masks.mask_boundaries(squares, ["video", "frame", "class"], v.SIDE, v.SIDE)


@query(
    "boundary_f_measure",
    v.with_views(*MASKS, extra={**EDGES, **conf_sql("video, frame", "edge_true", "edge_pred")})
    + f"""SELECT video, frame, true_class, pred_class, {s6('prec')} AS precision, {s6('rec')} AS recall,
    {s6('2 * prec * rec / (prec + rec)')} AS f_measure FROM conf""",
)
def boundary_f_measure(spark, sf):
    scored = ops.boundary_f_measure_of(v.label_frames(spark, sf), FRAME, v.GRID_H, v.GRID_W)
    return scored.select(
        *FRAME, "true_class", "pred_class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f_measure")]
    )


def renamed(views: dict[str, str], prefix: str) -> dict[str, str]:
    """The confusion views under other names, so that two can share a WITH clause."""
    out = {}
    for name, body in views.items():
        for other in views:
            body = body.replace(f"FROM {other} ", f"FROM {prefix}{other} ").replace(
                f"JOIN {other} ", f"JOIN {prefix}{other} "
            )
        out[prefix + name] = body
    return out


J_AND_F = {
    "fg_true": "SELECT * FROM true_mask WHERE class <> 0",
    "fg_edge": "SELECT * FROM edge_true WHERE class <> 0",
    **EDGES,
    **renamed(conf_sql("video, frame", "fg_true", "pred_mask"), "j_"),
    **renamed(conf_sql("video, frame", "fg_edge", "edge_pred"), "f_"),
    "nf": "SELECT video, count(DISTINCT frame) AS n_frames FROM pred_mask GROUP BY video",
    "j": "SELECT video, true_class, pred_class, sum(iou) AS j FROM j_conf GROUP BY ALL",
    "f": "SELECT video, true_class, pred_class, sum(2 * prec * rec / (prec + rec)) AS f FROM f_conf GROUP BY ALL",
    "jf": """SELECT video, true_class, pred_class, coalesce(j, 0) / n_frames AS j, coalesce(f, 0) / n_frames AS f,
      (coalesce(j, 0) + coalesce(f, 0)) / (2 * n_frames) AS score
      FROM j FULL JOIN f USING (video, true_class, pred_class) JOIN nf USING (video)""",
    **assignment_sql("jf", "score", "video", 10, 8, also=("j", "f")),
}
J_AND_F = {k: J_AND_F[k] for k in ["edge_true", "edge_pred", *[k for k in J_AND_F if not k.startswith("edge_")]]}


@query(
    "j_and_f",
    v.with_views(*MASKS, extra=J_AND_F)
    + f"""SELECT video, count(DISTINCT class) AS n_classes, {s6('max(coalesce(j, 0)) / count(DISTINCT class)')} AS jaccard,
    {s6('max(coalesce(f, 0)) / count(DISTINCT class)')} AS boundary_f_measure,
    {s6('max(coalesce(total, 0)) / count(DISTINCT class)')} AS j_and_f
    FROM fg_true LEFT JOIN best USING (video) GROUP BY video""",
)
def j_and_f(spark, sf):
    """Foreground J&F; classes are matched per video, all three scores are those of that matching."""
    scores = ops.j_and_f_of(v.label_frames(spark, sf), VIDEO, "frame", v.GRID_H, v.GRID_W, ignore_background=True)
    return scores.select(
        "video", "n_classes", *[r6(F.col(c)).alias(c) for c in ("jaccard", "boundary_f_measure", "j_and_f")]
    )


@query(
    "metric_mean_report",
    v.with_views(*MASKS, extra=ari_sql("video, frame"))
    + f"SELECT count(*) AS value_count, {s6('sum(ari)')} AS value_sum, {s6('sum(ari) / count(*)')} AS value FROM ari",
)
def metric_mean_report(spark, sf):
    """States of the videos merged into one."""
    partial = ops.metric_state(ops.adjusted_rand_index_of(cells(spark, sf, FRAME), FRAME), "ari", VIDEO)
    merged = ops.merge_states(partial)
    return merged.select("value_count", r6(F.col("value_sum")).alias("value_sum"), r6(F.col("value")).alias("value"))


@query(
    "slot_coverage",
    v.with_views("pred_mask")
    + f"""SELECT video, frame, CAST(s AS BIGINT) AS slot, {s6('count(*) FILTER (class = s) / count(*)::DOUBLE')} AS coverage
    FROM pred_mask, range({v.CLASSES}) r(s) GROUP BY video, frame, s""",
)
def slot_coverage(spark, sf):
    coverage = masks.slot_coverage(v.pred_mask(spark, sf), FRAME, v.CLASSES)
    return coverage.withColumn("coverage", r6(F.col("coverage")))


@query(
    "resize_nearest_mask",
    v.with_views("true_mask")
    + f"""SELECT video, frame, oy AS y, ox AS x, class FROM true_mask, range(7) a(oy), range(11) b(ox)
    WHERE y = floor((oy + 0.5) * {v.GRID_H} / 7) AND x = floor((ox + 0.5) * {v.GRID_W} / 11)""",
)
def resize_nearest_mask(spark, sf):
    resized = masks.resize_nearest(v.true_mask(spark, sf), (v.GRID_H, v.GRID_W), (7, 11))
    return resized.select("video", "frame", F.col("y").cast("long"), F.col("x").cast("long"), "class")
