"""Clustering and segmentation scores from label frames (`label_frames`) or pixel tables.

Functions named `..._of` start from label frames or their class-pair counts, which need no
shuffle of pixels; the others take pixel tables. All pixel work of those is one shuffle: true
and predicted rows are united and folded per point, which yields the classes of the point and
shows overlaps at the same time.
The next aggregation leaves class-pair counts per sample (cells), which map-side
aggregation already shrinks; totals, background removal and scores use only those.
Class pairs without a shared point are left out: their overlap is zero.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .label_frames import region_and_boundary
from .masks import drop_overlaps, mask_boundaries
from .matching import best_assignment, match_optimal

TRUE, PRED = "true_class", "pred_class"
BACKGROUND = 0


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(float(empty)))


def class_cells(
    true: DataFrame,
    pred: DataFrame,
    sample: Sequence[str],
    point: Sequence[str],
    cls: str = "class",
    ignore_overlaps: bool = False,
    overlaps_leave_pred: bool = False,
    one_pred: bool = True,
    ignore_background: bool = False,
) -> DataFrame:
    """(sample, true_class, pred_class, n, labelled): points per class pair, null where a side has none.

    A point of the masks needs exactly one predicted class (`one_pred`; boundaries are
    not whole masks). A row that repeats a point's class fails the job too, and with
    `ignore_background` so does a point without a true class.

    `labelled` says whether the cell has points with a true class, overlapping ones
    included. Overlapping true classes fail the job, or, when ignored, leave the truth
    and with `overlaps_leave_pred` the prediction too. So does a point with two
    predicted classes.
    """
    keys = [*sample, *point]
    none = F.lit(None).cast(true.schema[cls].dataType)
    sides = true.select(*keys, F.col(cls).alias("__t"), none.alias("__p")).unionByName(
        pred.select(*keys, none.alias("__t"), F.col(cls).alias("__p"))
    )
    points = sides.groupBy(*keys).agg(
        F.max("__t").alias("__t"),
        F.min("__t").alias("__low"),
        F.max("__p").alias("__p"),
        F.count("__t").alias("__n_t"),
        F.count("__p").alias("__n_p"),
    )
    overlap, nothing = F.col("__n_t") > 1, F.lit(None)
    true_class = F.when(
        overlap & (F.col("__t") == F.col("__low")), F.raise_error(F.lit("a true class is repeated at a point"))
    )
    if ignore_background:
        true_class = true_class.when(F.col("__n_t") == 0, F.raise_error(F.lit("a point has no true class")))
    true_class = true_class.when(~overlap, F.col("__t")).otherwise(
        nothing if ignore_overlaps else F.raise_error(F.lit("true classes overlap"))
    )
    pred_class = F.when(F.col("__n_p") > 1, F.raise_error(F.lit("predicted classes overlap")))
    if one_pred:
        pred_class = pred_class.when(F.col("__n_p") == 0, F.raise_error(F.lit("a point has no predicted class")))
    if ignore_overlaps and overlaps_leave_pred:
        pred_class = pred_class.when(overlap, nothing)
    return (
        points.withColumns({TRUE: true_class, PRED: pred_class.otherwise(F.col("__p"))})
        .groupBy(*sample, TRUE, PRED)
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("__n_t") > 0).alias("labelled"))
    )


def shared(cells: DataFrame, ignore_background: bool = False) -> DataFrame:
    """Cells with both classes, without the background class on request."""
    both = cells.filter(F.col(TRUE).isNotNull() & F.col(PRED).isNotNull())
    return both.filter(F.col(TRUE) != BACKGROUND) if ignore_background else both


def class_totals(cells: DataFrame, sample: Sequence[str], name: str, ignore_background: bool = False) -> DataFrame:
    """(sample, class, total) of one side; predicted points on background count."""
    kept = cells.filter(F.col(name).isNotNull())
    if ignore_background and name == TRUE:
        kept = kept.filter(F.col(TRUE) != BACKGROUND)
    return kept.groupBy(*sample, name).agg(F.sum("n").alias(f"n_{name}"))


def contingency(
    true: DataFrame, pred: DataFrame, sample: Sequence[str], point: Sequence[str], cls: str = "class"
) -> DataFrame:
    """(sample, true_class, pred_class, n): points that a true and a predicted class share."""
    return shared(class_cells(true, pred, sample, point, cls)).drop("labelled")


def confusion_of(cells: DataFrame, sample: Sequence[str], ignore_background: bool = False) -> DataFrame:
    """(sample, true_class, pred_class, tp, fp, fn) for every pair with tp > 0."""
    return (
        shared(cells, ignore_background)
        .join(class_totals(cells, sample, TRUE, ignore_background), [*sample, TRUE])
        .join(class_totals(cells, sample, PRED), [*sample, PRED])
        .select(
            *sample,
            TRUE,
            PRED,
            F.col("n").alias("tp"),
            (F.col(f"n_{PRED}") - F.col("n")).alias("fp"),
            (F.col(f"n_{TRUE}") - F.col("n")).alias("fn"),
        )
    )


def confusion(
    true: DataFrame, pred: DataFrame, sample: Sequence[str], point: Sequence[str], cls: str = "class"
) -> DataFrame:
    return confusion_of(class_cells(true, pred, sample, point, cls), sample)


def adjusted_rand_index(
    true: DataFrame,
    pred: DataFrame,
    sample: Sequence[str],
    point: Sequence[str],
    cls: str = "class",
    ignore_background: bool = False,
    ignore_overlaps: bool = False,
) -> DataFrame:
    """(sample, ari) for every sample with any true pixel; 1.0 when the index is undefined.

    Samples count before background and overlaps are removed, so one that holds
    nothing else scores 1.0.
    """
    cells = class_cells(true, pred, sample, point, cls, ignore_overlaps, ignore_background=ignore_background)
    return adjusted_rand_index_of(cells, sample, ignore_background)


def adjusted_rand_index_of(cells: DataFrame, sample: Sequence[str], ignore_background: bool = False) -> DataFrame:
    """The same from class-pair counts."""
    scored = cells.groupBy(*sample).agg(F.max("labelled").alias("labelled")).filter("labelled").drop("labelled")
    both = shared(cells, ignore_background).withColumn("n", F.col("n").cast("double"))

    def pairs_in(column: Column) -> Column:
        return column * (column - 1)

    by_true = (
        both.groupBy(*sample, TRUE)
        .agg(F.sum("n").alias("row_n"), F.sum(pairs_in(F.col("n"))).alias("row_cells"))
        .groupBy(*sample)
        .agg(
            F.sum("row_n").alias("points"),
            F.sum("row_cells").alias("same_both"),
            F.sum(pairs_in(F.col("row_n"))).alias("same_true"),
        )
    )
    by_pred = (
        both.groupBy(*sample, PRED)
        .agg(F.sum("n").alias("col_n"))
        .groupBy(*sample)
        .agg(F.sum(pairs_in(F.col("col_n"))).alias("same_pred"))
    )
    expected = F.col("same_true") * F.col("same_pred") / F.greatest(pairs_in(F.col("points")), F.lit(1.0))
    spread = (F.col("same_true") + F.col("same_pred")) / 2 - F.col("expected")
    return (
        scored.join(by_true, list(sample), "left")
        .join(by_pred, list(sample), "left")
        .fillna(0.0, ["points", "same_both", "same_true", "same_pred"])
        .withColumn("expected", expected)
        .withColumn("ari", ratio(F.col("same_both") - F.col("expected"), spread, 1.0))
        .select(*sample, "ari")
    )


def pairwise_iou(conf: DataFrame) -> DataFrame:
    """Adds iou to confusion rows."""
    return conf.withColumn("iou", ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))


def pairwise_f_measure(conf: DataFrame) -> DataFrame:
    """Adds precision, recall and f_measure to confusion rows."""
    return (
        conf.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn(
            "f_measure",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def matched_iou(
    true: DataFrame,
    pred: DataFrame,
    sample: Sequence[str],
    point: Sequence[str],
    matching: str,
    cls: str = "class",
    n_classes: tuple[int, int] | None = None,
    ignore_background: bool = False,
    ignore_overlaps: bool = False,
) -> DataFrame:
    """(sample, true_class, iou) of every true class that occurs, under one matching.

    none: the predicted class with the same index (equal class counts, when given);
    overlap: the best predicted class; optimal: one-to-one with the largest total.
    """
    cells = class_cells(true, pred, sample, point, cls, ignore_overlaps, True, ignore_background=ignore_background)
    return matched_iou_of(cells, sample, matching, n_classes, ignore_background)


def matched_iou_of(
    cells: DataFrame,
    sample: Sequence[str],
    matching: str,
    n_classes: tuple[int, int] | None = None,
    ignore_background: bool = False,
) -> DataFrame:
    """The same from class-pair counts."""
    ious = pairwise_iou(confusion_of(cells, sample, ignore_background))
    if matching == "none":
        if n_classes is not None and n_classes[0] != n_classes[1]:
            raise ValueError(f"class counts differ: {n_classes[0]} and {n_classes[1]}")
        chosen = ious.filter(F.col(TRUE) == F.col(PRED)).select(*sample, TRUE, "iou")
    elif matching == "overlap":
        chosen = ious.groupBy(*sample, TRUE).agg(F.max("iou").alias("iou"))
    elif matching == "optimal":
        chosen = match_optimal(ious, sample, "iou").select(*sample, TRUE, "iou")
    else:
        raise ValueError(f"unknown matching {matching}")
    classes = class_totals(cells, sample, TRUE, ignore_background).select(*sample, TRUE)
    return classes.join(chosen, [*sample, TRUE], "left").fillna(0.0, ["iou"])


def mean_iou(
    true: DataFrame,
    pred: DataFrame,
    sample: Sequence[str],
    point: Sequence[str],
    matching: str = "overlap",
    cls: str = "class",
    ignore_background: bool = False,
    ignore_overlaps: bool = False,
) -> DataFrame:
    """(sample, n_classes, mean_iou) over the true classes left after the removals.

    A sample without such a class has no row. Predicted pixels on removed background
    still count in the union.
    """
    return mean_of(
        matched_iou(true, pred, sample, point, matching, cls, None, ignore_background, ignore_overlaps), sample
    )


def mean_iou_of(
    cells: DataFrame, sample: Sequence[str], matching: str = "overlap", ignore_background: bool = False
) -> DataFrame:
    """The same from class-pair counts."""
    return mean_of(matched_iou_of(cells, sample, matching, None, ignore_background), sample)


def mean_of(matched: DataFrame, sample: Sequence[str]) -> DataFrame:
    return matched.groupBy(*sample).agg(
        F.count(F.lit(1)).alias("n_classes"), F.avg("iou").alias("mean_iou")
    )


def boundary_f_measure(
    true: DataFrame,
    pred: DataFrame,
    frame: Sequence[str],
    height: int,
    width: int,
    cls: str = "class",
    ignore_background: bool = False,
) -> DataFrame:
    """Pairwise precision, recall and F of the mask boundaries; masks carry y, x and class."""
    keys = [*frame, cls]
    edges = class_cells(
        mask_boundaries(true, keys, height, width),
        mask_boundaries(pred, keys, height, width),
        frame,
        ["y", "x"],
        cls,
        one_pred=False,
    )
    return pairwise_f_measure(confusion_of(edges, frame, ignore_background))


def j_and_f(
    true: DataFrame,
    pred: DataFrame,
    video: Sequence[str],
    frame: str,
    height: int,
    width: int,
    match_by: str = "j_and_f",
    cls: str = "class",
    ignore_background: bool = False,
    ignore_overlaps: bool = False,
) -> DataFrame:
    """(video, n_classes, jaccard, boundary_f_measure, j_and_f) per video.

    Region and boundary scores are taken frame by frame and averaged over all frames
    of the video, classes are matched one-to-one by `match_by`, and the matched
    values are averaged over the true classes that occur.
    """
    if match_by not in ("j_and_f", "jaccard", "f_measure"):
        raise ValueError(f"unknown matching score {match_by}")
    per_frame = [*video, frame]
    # Every frame counts, also one that loses all its points to overlaps.
    n_frames = pred.groupBy(*video).agg(F.count_distinct(frame).alias("n_frames"))
    if ignore_overlaps:
        true, pred = drop_overlaps(true, pred, [*per_frame, "y", "x"], from_pred=True, cls=cls)
    cells = class_cells(true, pred, per_frame, ["y", "x"], cls)
    pair = [*video, TRUE, PRED]
    region = (
        pairwise_iou(confusion_of(cells, per_frame, ignore_background)).groupBy(*pair).agg(F.sum("iou").alias("j_sum"))
    )
    # Each class has its own boundary, so the background's leaves without touching the others.
    contour = (
        boundary_f_measure(true, pred, per_frame, height, width, cls, ignore_background)
        .groupBy(*pair)
        .agg(F.sum("f_measure").alias("f_sum"))
    )
    scores = (
        region.join(contour, pair, "full")
        .join(n_frames, list(video))
        .select(
            *pair,
            (F.coalesce("j_sum", F.lit(0.0)) / F.col("n_frames")).alias("jaccard"),
            (F.coalesce("f_sum", F.lit(0.0)) / F.col("n_frames")).alias("f_measure"),
        )
        .withColumn("j_and_f", (F.col("jaccard") + F.col("f_measure")) / 2)
    )
    matched = (
        match_optimal(scores, video, match_by)
        .groupBy(*video)
        .agg(*[F.sum(c).alias(c) for c in ("jaccard", "f_measure", "j_and_f")])
    )
    active = class_totals(cells, video, TRUE, ignore_background).groupBy(*video).agg(
        F.count(F.lit(1)).alias("n_classes")
    )
    return active.join(matched, list(video), "left").select(
        *video,
        "n_classes",
        *[
            (F.coalesce(source, F.lit(0.0)) / F.col("n_classes")).alias(name)
            for source, name in (
                ("jaccard", "jaccard"),
                ("f_measure", "boundary_f_measure"),
                ("j_and_f", "j_and_f"),
            )
        ],
    )


def boundary_f_measure_of(
    frames: DataFrame, frame: Sequence[str], height: int, width: int, ignore_background: bool = False
) -> DataFrame:
    """(frame, true_class, pred_class, precision, recall, f_measure) of label frames, for pairs whose boundaries meet."""
    rows = region_and_boundary(frames, frame, height, width, ignore_background=ignore_background)
    return rows.filter("shared").drop("iou", "shared")


def j_and_f_of(
    frames: DataFrame,
    video: Sequence[str],
    frame: str,
    height: int,
    width: int,
    match_by: str = "j_and_f",
    ignore_background: bool = False,
    ignore_overlaps: bool = False,
) -> DataFrame:
    """`j_and_f` of label frames: regions and boundaries are scored in one pass, then one row a class pair is moved."""
    if match_by not in ("j_and_f", "jaccard", "f_measure"):
        raise ValueError(f"unknown matching score {match_by}")
    rows = region_and_boundary(
        frames, [*video, frame], height, width, ignore_background=ignore_background, ignore_overlaps=ignore_overlaps
    )
    sums = rows.groupBy(*video, TRUE, PRED).agg(
        F.sum("iou").alias("j"), F.sum("f_measure").alias("f"), F.count(F.lit(1)).alias("n")
    )
    # A video's class pairs meet in the task that matches them, with its number of frames.
    schema = T.StructType(
        [frames.schema[c] for c in video]
        + [T.StructField("n_classes", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("jaccard", "boundary_f_measure", "j_and_f")]
    )

    def match(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        n_frames = table.loc[table[TRUE].isna(), "n"].sum()
        n_classes = int((table[TRUE].notna() & table[PRED].isna()).sum())
        pairs = table[table[PRED].notna()]
        if not n_classes:
            return pd.DataFrame([], columns=schema.fieldNames())
        scores = {"jaccard": pairs["j"] / n_frames, "f_measure": pairs["f"] / n_frames}
        scores["j_and_f"] = (scores["jaccard"] + scores["f_measure"]) / 2
        rows, row_of = np.unique(pairs[TRUE], return_inverse=True)
        cols, col_of = np.unique(pairs[PRED], return_inverse=True)
        gain = np.zeros((len(rows), len(cols)))
        gain[row_of, col_of] = scores[match_by]
        chosen = np.zeros(gain.shape, bool)
        for r, c in best_assignment(gain):
            chosen[r, c] = True
        means = [scores[name][chosen[row_of, col_of]].sum() / n_classes for name in ("jaccard", "f_measure", "j_and_f")]
        return pd.DataFrame([[*key, n_classes, *means]], columns=schema.fieldNames())

    return sums.groupBy(*video).applyInPandas(match, schema)


def metric_state(scores: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mergeable state of a metric: sum of values and their number."""
    return scores.groupBy(*keys).agg(F.sum(value).alias("value_sum"), F.count(value).alias("value_count"))


def merge_states(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Final value from any number of partial states; null when nothing was scored."""
    merged = states.groupBy(*keys).agg(
        F.sum("value_sum").alias("value_sum"), F.sum("value_count").alias("value_count")
    )
    return merged.withColumn("value", F.try_divide("value_sum", "value_count"))
