"""Packed label arrays against the pixel form, golden values, input rules and what is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import label_frames, masks, metrics
from framelake.plans import metrics as plans

FRAME, VIDEO = ["video", "frame"], ["video"]


def packed(spark, *frames):
    """Rows (video, frame, true, pred) from (video, frame, true labels, predicted labels)."""
    rows = [(v, f, *(bytearray(np.array(x, np.int32).tobytes()) for x in (t, p))) for v, f, t, p in frames]
    return spark.createDataFrame(rows, "video long, frame long, true binary, pred binary")


def pixel_rows(spark, side, width, *frames):
    rows = [(r[0], r[1], i // width, i % width, int(c)) for r in frames for i, c in enumerate(np.ravel(r[2 + side])) if c >= 0]
    return spark.createDataFrame(rows, "video long, frame long, y long, x long, class long")


def random_frames(seed=1, height=12, width=15):
    draw = np.random.default_rng(seed)
    for video in range(3):
        for frame in range(4):
            true, pred = (np.kron(draw.integers(0, 4, (height // 3, width // 3)), np.ones((3, 3), int)) for _ in range(2))
            pred = np.where(draw.random(pred.shape) < 0.1, 4, np.where(draw.random(pred.shape) < 0.5, true, pred))
            yield video, frame, true, pred


def rows_of(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def frames():
    return list(random_frames())


@pytest.fixture(scope="module")
def sides(spark, frames):
    return packed(spark, *frames), pixel_rows(spark, 0, 15, *frames), pixel_rows(spark, 1, 15, *frames)


def test_packing_is_the_inverse_of_pixels(spark, sides):
    dense, true, _ = sides
    again = label_frames.pack_labels(true, FRAME, 12, 15, {"true": F.col("class")})
    assert rows_of(again.withColumn("true", F.hex("true"))) == rows_of(dense.select(*FRAME, F.hex("true")))
    assert rows_of(label_frames.pixels(again, FRAME, "true", 15)) == rows_of(true)


@pytest.mark.parametrize("sample,point", [(FRAME, ["y", "x"]), (VIDEO, ["frame", "y", "x"])])
def test_counts_and_scores_equal_the_pixel_form(sides, sample, point):
    dense, true, pred = sides
    cells = label_frames.class_cells(dense, FRAME, sample)
    assert rows_of(cells) == rows_of(metrics.class_cells(true, pred, sample, point).select(cells.columns))
    for background in (False, True):
        ari = metrics.adjusted_rand_index_of(cells, sample, background)
        assert rows_of(ari) == rows_of(metrics.adjusted_rand_index(true, pred, sample, point, ignore_background=background))
        for matching in ("none", "overlap", "optimal"):
            own = metrics.mean_iou_of(cells, sample, matching, background)
            assert rows_of(own) == rows_of(metrics.mean_iou(true, pred, sample, point, matching, ignore_background=background))


@pytest.mark.parametrize("background", [False, True])
def test_boundaries_and_j_and_f_equal_the_pixel_form(sides, background):
    dense, true, pred = sides
    edges = label_frames.pixels(label_frames.mask_boundaries(dense, FRAME, "true", 12, 15), FRAME, "true", 15)
    plain = masks.mask_boundaries(true, [*FRAME, "class"], 12, 15)
    assert rows_of(edges) == rows_of(plain.select(edges.columns))
    own = metrics.boundary_f_measure_of(dense, FRAME, 12, 15, background)
    assert rows_of(own) == rows_of(metrics.boundary_f_measure(true, pred, FRAME, 12, 15, "class", background).select(own.columns))
    own = metrics.j_and_f_of(dense, VIDEO, "frame", 12, 15, ignore_background=background)
    assert rows_of(own) == rows_of(metrics.j_and_f(true, pred, VIDEO, "frame", 12, 15, ignore_background=background))


def test_boundaries_of_squares_are_frames_of_one_pixel():
    image = np.full((32, 32), label_frames.NONE, np.int32)
    image[0:9, 0:9], image[12:20, 12:20] = 0, 1
    expected = np.full_like(image, label_frames.NONE)
    for c, (a, b) in enumerate(((0, 9), (12, 20))):
        expected[a:b, a:b] = c
        expected[a + 1 : b - 1, a + 1 : b - 1] = label_frames.NONE
    assert (label_frames.boundaries(image, 1) == expected).all()
    wide = label_frames.boundaries(np.zeros((9, 9), np.int32), 3)
    assert (wide < 0).sum() == 9  # 3 x 3 points are further than three from the border


def test_golden_scores_of_j_and_f(spark):
    """A perfect sample, and one whose prediction splits the true classes."""
    true = [[0, 0], [1, 1]]
    dense = packed(spark, (0, 0, true, true), (1, 0, true, [[0, 1], [2, 3]]))
    out = metrics.j_and_f_of(dense, VIDEO, "frame", 2, 2).orderBy("video").collect()
    assert out[0][1:] == (2, 1.0, 1.0, 1.0)
    assert out[1][1:] == (2, pytest.approx(0.5), pytest.approx(2 / 3), pytest.approx((0.5 + 2 / 3) / 2))


def test_overlapping_truth(spark):
    rows = [(0, 0, 0, x, c, p) for x, c, p in ((0, 0, 0), (1, 1, 1), (2, 1, 1), (3, 2, 2), (3, 1, None))]
    points = spark.createDataFrame(rows, "video long, frame long, y long, x long, t long, p long")
    dense = label_frames.pack_labels(points, FRAME, 1, 4, {"true": F.col("t"), "pred": F.col("p")})
    with pytest.raises(Exception, match="true classes overlap"):
        label_frames.class_cells(dense, FRAME, FRAME).collect()
    kept = label_frames.class_cells(dense, FRAME, FRAME, ignore_overlaps=True, overlaps_leave_pred=True)
    assert {(r.true_class, r.pred_class, r.n) for r in kept.collect()} == {(0, 0, 1), (1, 1, 2), (None, None, 1)}
    out = metrics.j_and_f_of(dense, VIDEO, "frame", 1, 4, ignore_overlaps=True).first()
    assert (out.n_classes, out.jaccard) == (2, 1.0)


@pytest.mark.parametrize(
    "true,pred,options,message",
    [
        ([0, -1], [0, 0], {"ignore_background": True}, "no true class"),
        ([0, 1], [0, -1], {}, "no predicted class"),
        ([0, 1], [0, -2], {}, "predicted classes overlap"),
        ([0, -2], [0, 1], {"ignore_background": True}, "true classes overlap"),
    ],
)
def test_broken_masks_fail(spark, true, pred, options, message):
    dense = packed(spark, (0, 0, [true], [pred]))
    with pytest.raises(Exception, match=message):
        label_frames.class_cells(dense, FRAME, FRAME, **options).collect()


def test_pixel_rows_that_cannot_be_packed_fail(spark):
    for rows, message in (([(0, 0, 0, 0, 1)] * 2, "repeated"), ([(0, 0, 5, 0, 1)], "outside")):
        points = spark.createDataFrame(rows, "video long, frame long, y long, x long, class long")
        with pytest.raises(Exception, match=message):
            label_frames.pack_labels(points, FRAME, 2, 2, {"true": F.col("class")}).collect()


def test_a_pixel_without_a_true_class_fails_with_background_ignored(spark):
    true = spark.createDataFrame([(0, 0, 0, 1)], "sample long, y long, x long, class long")
    pred = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1)], true.schema)
    with pytest.raises(Exception, match="no true class"):
        metrics.adjusted_rand_index(true, pred, ["sample"], ["y", "x"], ignore_background=True).collect()
    assert metrics.adjusted_rand_index(true, pred, ["sample"], ["y", "x"]).count() == 1


def shuffled(df):
    """Rows that the exchanges of a query have written."""
    df.collect()
    total = 0

    def walk(node):
        nonlocal total
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_no_pixel_is_shuffled(sides):
    dense, true, pred = sides
    own = shuffled(label_frames.class_cells(dense, FRAME, VIDEO))
    assert 10 * own < shuffled(metrics.class_cells(true, pred, VIDEO, ["frame", "y", "x"]))


def test_the_j_and_f_query_has_few_exchanges(spark, sf):
    plan = plans.j_and_f(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 8
