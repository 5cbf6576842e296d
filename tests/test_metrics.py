"""Golden values of the clustering and segmentation scores."""

import itertools

import numpy as np
import pytest

from framelake.operators import masks, metrics
from framelake.operators.matching import best_assignment

SAMPLE, POINT = ["sample"], ["y", "x"]


def points(spark, *samples):
    """Rows (sample, y, x, class) from lists of labels; None leaves a point out."""
    rows = [(s, 0, i, c) for s, labels in enumerate(samples) for i, c in enumerate(labels) if c is not None]
    return spark.createDataFrame(rows, "sample long, y long, x long, class long")


def grid(spark, *images):
    rows = [(s, y, x, c) for s, image in enumerate(images) for y, row in enumerate(image) for x, c in enumerate(row)]
    return spark.createDataFrame(rows, "sample long, y long, x long, class long")


def scores(df, column):
    return [r[column] for r in df.orderBy("sample").collect()]


@pytest.mark.parametrize(
    ("pred", "expected"),
    [
        ([0, 0, 1, 1], 1.0),
        ([1, 1, 0, 0], 1.0),
        ([0, 0, 1, 2], 0.571428571),
        ([0, 1, 2, 3], 0.0),
        ([0, 1, 0, 1], -0.5),
    ],
)
def test_adjusted_rand_index(spark, pred, expected):
    out = metrics.adjusted_rand_index(points(spark, [0, 0, 1, 1]), points(spark, pred), SAMPLE, POINT)
    assert scores(out, "ari") == [pytest.approx(expected)]


def test_background_only_sample_scores_one_and_empty_sample_is_skipped(spark):
    true, pred = points(spark, [0, 0, 0, 0]), points(spark, [0, 0, 1, 1])
    out = metrics.adjusted_rand_index(true, pred, SAMPLE, POINT, ignore_background=True)
    assert [tuple(r) for r in out.collect()] == [(0, 1.0)]
    true, pred = points(spark, [0, 0, 1, 1], [None] * 4), points(spark, [0, 0, 1, 1], [0, 1, 0, 1])
    out = metrics.adjusted_rand_index(true, pred, SAMPLE, POINT)
    assert [tuple(r) for r in out.collect()] == [(0, 1.0)]


def test_ari_ignores_overlaps_only_in_the_truth(spark):
    true = points(spark, [0, 0, 1, 1, 2, 2])
    overlap = true.union(spark.createDataFrame([(0, 0, 4, 1), (0, 0, 5, 1)], true.schema))
    out = metrics.adjusted_rand_index(overlap, points(spark, [0, 0, 1, 1, 2, 3]), SAMPLE, POINT, ignore_overlaps=True)
    assert scores(out, "ari") == [1.0]


def test_overlap_iou_over_images(spark):
    true = grid(spark, [[0, 0], [1, 1]], [[0, 0], [1, 1]])
    pred = grid(spark, [[0, 0], [1, 1]], [[0, 1], [2, 3]])
    per_image = metrics.mean_iou(true, pred, SAMPLE, POINT, "overlap")
    assert scores(per_image, "mean_iou") == [1.0, 0.5]
    state = metrics.metric_state(per_image, "mean_iou", SAMPLE)
    assert metrics.merge_states(state).first()["value"] == 0.75


@pytest.mark.parametrize(
    ("true", "pred", "overlap", "optimal"),
    [
        ([0, 0, 1, 2], [0, 0, 1, 1], [1, 0.5, 0.5], [1, 0.5, 0]),
        ([0, 0, 1, 1, 1, 1], [1, 1, 1, 1, 1, 3], [0.4, 0.5], [0.4, 0.25]),
        ([0, 0, 1, 1], [0, 0, 1, 2], [1, 0.5], [1, 0.5]),
    ],
)
def test_iou_matchings(spark, true, pred, overlap, optimal):
    t, p = points(spark, true), points(spark, pred)
    for matching, expected in (("overlap", overlap), ("optimal", optimal)):
        out = metrics.matched_iou(t, p, SAMPLE, POINT, matching).orderBy("true_class").collect()
        values = [r["iou"] for r in out]
        if matching == "optimal":
            # Ties may pick another pairing with the same total.
            assert sum(values) == pytest.approx(sum(expected))
        else:
            assert values == [pytest.approx(e) for e in expected]


def test_iou_matching_none(spark):
    out = metrics.matched_iou(points(spark, [1, 1, 0, 0]), points(spark, [0, 0, 1, 1]), SAMPLE, POINT, "none")
    assert [r["iou"] for r in out.collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        metrics.matched_iou(points(spark, [0]), points(spark, [0]), SAMPLE, POINT, "none", n_classes=(2, 3))
    with pytest.raises(ValueError):
        metrics.matched_iou(points(spark, [0]), points(spark, [0]), SAMPLE, POINT, "nearest")


def test_background_pixels_of_the_prediction_stay_in_the_union(spark):
    out = metrics.mean_iou(
        points(spark, [0, 0, 1, 1]), points(spark, [1, 1, 1, 1]), SAMPLE, POINT, ignore_background=True
    ).first()
    assert (out["n_classes"], out["mean_iou"]) == (1, 0.5)


def test_overlaps_leave_both_sides(spark):
    true = points(spark, [0, 0, 1, 1, 2, 2])
    overlap = true.union(spark.createDataFrame([(0, 0, 4, 0), (0, 0, 5, 0)], true.schema))
    out = metrics.mean_iou(overlap, points(spark, [0, 0, 1, 1, 2, 3]), SAMPLE, POINT, ignore_overlaps=True)
    assert scores(out, "mean_iou") == [1.0]
    none = metrics.mean_iou(points(spark, [None]), points(spark, [0]), SAMPLE, POINT)
    assert none.count() == 0


def test_j_and_f(spark):
    def video(df):
        return df.withColumnRenamed("sample", "video").selectExpr("video", "0L as frame", "y", "x", "class")

    true = video(grid(spark, [[0, 0], [1, 1]], [[0, 0], [1, 1]]))
    pred = video(grid(spark, [[0, 0], [1, 1]], [[0, 1], [2, 3]]))
    rows = metrics.j_and_f(true, pred, ["video"], "frame", 2, 2).collect()
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    assert mean("jaccard") == pytest.approx(0.75)
    assert mean("boundary_f_measure") == pytest.approx(5 / 6)
    assert mean("j_and_f") == pytest.approx((1 + (0.5 + 2 / 3) / 2) / 2)
    with pytest.raises(ValueError):
        metrics.j_and_f(true, pred, ["video"], "frame", 2, 2, match_by="iou")


def test_boundaries_are_one_pixel_frames(spark):
    boxes = {0: (0, 9), 1: (12, 20)}
    rows = [(m, y, x) for m, (a, b) in boxes.items() for y in range(a, b) for x in range(a, b)]
    mask = spark.createDataFrame(rows, "mask long, y long, x long")
    edge = {tuple(r) for r in masks.mask_boundaries(mask, ["mask"], 32, 32).collect()}
    expected = {(m, y, x) for m, y, x in rows if {y, x} & {boxes[m][0], boxes[m][1] - 1}}
    assert edge == expected


def test_validation_finds_each_broken_rule(spark):
    true = points(spark, [0, 1, 1], [0, 0, 0], [0, None, 0])
    true = true.union(spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 0)], true.schema))
    pred = points(spark, [0, 0, 0], [0, 0, 0], [0, 0, None])
    rows = {r["sample"]: r for r in masks.mask_validation(true, pred, SAMPLE, POINT).collect()}
    assert rows[0]["true_overlaps"] == 1 and not rows[0]["ok"]
    assert rows[1]["true_not_binary"] == 1 and not rows[1]["ok"]
    assert rows[2]["pred_not_onehot"] == 1 and rows[2]["true_not_onehot"] == 1 and not rows[2]["ok"]
    report = masks.mask_validation(true.filter("sample = 0"), pred.filter("sample = 0"), SAMPLE, POINT, ignore_overlaps=True)
    assert report.first()["ok"]
    with pytest.raises(Exception, match="input rules"):
        masks.require_valid(masks.mask_validation(true, pred, SAMPLE, POINT)).collect()


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, size=2)
        gain = rng.random((n, m)).round(1)
        pairs = best_assignment(gain)
        assert len(pairs) == min(n, m)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        g = gain if n <= m else gain.T
        best = max(sum(g[i, j] for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
        assert sum(gain[r, c] for r, c in pairs) == pytest.approx(best)


def test_overlapping_classes_fail_unless_ignored(spark):
    true, pred = points(spark, [0, 1]), points(spark, [0, 1])
    twice = true.union(spark.createDataFrame([(0, 0, 0, 1)], true.schema))
    with pytest.raises(Exception, match="true classes overlap"):
        metrics.mean_iou(twice, pred, SAMPLE, POINT).collect()
    with pytest.raises(Exception, match="predicted classes overlap"):
        metrics.adjusted_rand_index(true, twice, SAMPLE, POINT).collect()
    assert scores(metrics.mean_iou(twice, pred, SAMPLE, POINT, ignore_overlaps=True), "mean_iou") == [1.0]


def test_slot_coverage_includes_absent_slots(spark):
    out = masks.slot_coverage(points(spark, [0, 0, 0, 2]), SAMPLE, 3).orderBy("slot").collect()
    assert [r["coverage"] for r in out] == [0.75, 0.0, 0.25]


def test_soft_mask_ties_and_range(spark):
    soft = spark.createDataFrame([(0, 0, 0.4), (0, 1, 0.4), (1, 0, 0.1), (1, 1, 0.9)], "p long, slot long, value double")
    assert [r["class"] for r in masks.soft_to_hard(soft, ["p"]).orderBy("p").collect()] == [0, 1]
    fixed = masks.soft_to_hard(soft, ["p"], n_slots=2)
    assert [r["class"] for r in fixed.orderBy("p").collect()] == [0, 1]
    bad = spark.createDataFrame([(0, 0, 1.5)], soft.schema)
    with pytest.raises(Exception, match="outside"):
        masks.soft_to_hard(bad, ["p"]).collect()


def _points(spark, rows):
    return spark.createDataFrame(rows, "video long, frame long, y long, x long, class long")


def test_masks_with_missing_or_repeated_points_are_refused(spark):
    whole = [(0, 0, 0, i, i % 2) for i in range(4)]
    true, pred = _points(spark, whole), _points(spark, whole)
    key, point = ["video"], ["frame", "y", "x"]
    assert metrics.adjusted_rand_index(true, pred, key, point).first()["ari"] == 1.0
    bad = {
        "no predicted class": (true, _points(spark, whole[:2])),
        "true class is repeated": (_points(spark, whole + whole[:1]), pred),
        "predicted classes overlap": (true, _points(spark, whole + whole[:1])),
    }
    for message, (t, p) in bad.items():
        for score in (
            lambda: metrics.adjusted_rand_index(t, p, key, point, ignore_overlaps=True),
            lambda: metrics.mean_iou(t, p, key, point, ignore_overlaps=True),
        ):
            with pytest.raises(Exception, match=message):
                score().collect()
