"""Frames with fewer patches than the grid: the last one of a table, and points that a mask lacks."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from check_oracle import compare, connect
from framelake.operators import agreement, frames, label_frames, metrics

FRAME, VIDEO = ["video", "frame"], ["video"]
QUERIES = [
    "agreement_rollup", "agreement_topk", "ari_per_sample", "boundary_f_measure", "fg_ari", "image_ari", "image_mbo",
    "iou_match_none", "iou_match_optimal", "j_and_f", "mean_iou", "metric_mean_report", "pairwise_f_measure",
    "pairwise_iou", "predict_features", "video_ari", "video_mbo", "agreement_argmax_hist", "agreement_correlation",
    "agreement_divergence", "agreement_errors", "resize_bilinear", "video_report", "soft_cross_entropy",
]


def written(folder, sf, feature):
    """The first 156 vectors: two videos, whose last frames are full and of 16 patches."""
    source = os.path.join(sf, "embeddings.parquet")
    duckdb.sql(f"COPY (SELECT vec_id, {feature} AS embedding, label FROM '{source}' WHERE vec_id < 156 ORDER BY 1) TO '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.fixture(scope="module")
def partial(tmp_path_factory, sf):
    return written(tmp_path_factory.mktemp("partial"), sf, "embedding")


@pytest.fixture(scope="module")
def even(tmp_path_factory, sf):
    """The third frame is negative and the fourth positive, so no affinity reaches the threshold and targets are even."""
    sign = "CASE WHEN vec_id BETWEEN 40 AND 59 THEN -1 WHEN vec_id BETWEEN 60 AND 79 THEN 1 END"
    feature = f"CASE WHEN vec_id BETWEEN 40 AND 79 THEN list_transform(embedding, lambda x: abs(x) * {sign}) ELSE embedding END"
    return written(tmp_path_factory.mktemp("even"), sf, feature)


@pytest.mark.parametrize("name", QUERIES)
def test_a_partial_last_frame_gives_the_rows_of_the_sql(spark, partial, name):
    status, _, rows = compare(spark, connect(partial), partial, name, oracle_sql()[name])
    assert status == "ok" and rows > 0, status


@pytest.mark.parametrize("name", ["agreement_argmax_hist", "video_report"])
def test_of_equal_targets_the_first_counts(spark, even, name):
    status, _, rows = compare(spark, connect(even), even, name, oracle_sql()[name])
    assert status == "ok" and rows > 0, status


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_absent_points_count_nowhere(spark):
    draw = np.random.default_rng(5)
    rows = [
        (0, f, y, x, int(draw.integers(3)), int(draw.integers(3)))
        for f in range(3) for y in range(7) for x in range(6) if draw.random() < 0.8
    ]
    points = spark.createDataFrame(rows, "video long, frame long, y long, x long, t long, p long")
    true, pred = (points.select(*FRAME, "y", "x", F.col(c).alias("class")) for c in "tp")
    dense = label_frames.pack_labels(points, FRAME, 7, 6, {"true": F.col("t"), "pred": F.col("p")})
    for background in (False, True):
        cells = label_frames.class_cells(dense, FRAME, VIDEO, ignore_background=background)
        plain = metrics.class_cells(true, pred, VIDEO, ["frame", "y", "x"], ignore_background=background)
        assert rows_of(cells) == rows_of(plain.select(cells.columns))
        own = metrics.j_and_f_of(dense, VIDEO, "frame", 7, 6, ignore_background=background)
        plain = metrics.j_and_f(true, pred, VIDEO, "frame", 7, 6, ignore_background=background)
        assert rows_of(own) == rows_of(plain.select(own.columns))


@pytest.mark.parametrize("side,message", [("p", "no predicted class"), ("t", "no true class")])
def test_a_point_that_one_side_lacks_still_fails(spark, side, message):
    rows = [(0, 0, 0, 0, 1, 1), (0, 0, 0, 1, *((None, 1) if side == "t" else (1, None)))]
    points = spark.createDataFrame(rows, "video long, frame long, y long, x long, t long, p long")
    dense = label_frames.pack_labels(points, FRAME, 1, 3, {"true": F.col("t"), "pred": F.col("p")})
    with pytest.raises(Exception, match=message):
        label_frames.class_cells(dense, FRAME, VIDEO, ignore_background=True).collect()


def test_golden_statistics_of_a_shorter_target(spark):
    row = spark.createDataFrame([([0.5, 0.0], [0.75, 0.25], [0.2, 0.3, 0.5])], "affinity array<double>, target array<double>, prediction array<double>")
    out = agreement.row_statistics(row).first()
    assert (out.n, out.target_prediction_n, out.target_idx, out.pred_idx, out.target_rank) == (3, 2, 0, 1, 2)
    assert (out.tv, out.pred_at_target, out.target_at_pred) == pytest.approx((0.3, 0.2, 0.25))


def test_a_resized_pixel_needs_all_it_reads(spark):
    rows = [(0, y, x, 1.0) for y in range(2) for x in range(4) if (y, x) != (1, 3)]
    out = frames.resize_bilinear(spark.createDataFrame(rows, "k long, y long, x long, value double"), ["k"], (2, 4), (4, 16)).collect()
    assert {r.value for r in out} == {1.0}
    # all four output rows read both input rows but the last, which is clamped; columns from 2.125 on read column 3
    assert len([r for r in out if r.y < 3]) == 3 * 10
    whole = frames.resize_bilinear(spark.createDataFrame([*rows, (0, 1, 3, 1.0)], "k long, y long, x long, value double"), ["k"], (2, 4), (4, 16))
    assert whole.count() == 64
