"""Masks as pixel tables: (sample keys, y, x, class); only set pixels have rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import boundary_dilation, nearest_source


def soft_to_hard(
    soft: DataFrame,
    point: Sequence[str],
    slot: str = "slot",
    value: str = "value",
    threshold: float | None = None,
    strict: bool = True,
    n_slots: int | None = None,
) -> DataFrame:
    """(point, class): the slot with the largest value, the lowest slot on ties.

    With a threshold, values become 0/1 first. A value outside [0, 1] is an error.
    With the slot count given, each slot gets its own plain maximum, so the
    aggregation is hashed; without it the pair (value, slot) is compared, which sorts.
    """
    v = F.col(value)
    if strict:
        v = F.when((v >= 0) & (v <= 1), v).otherwise(F.raise_error(F.lit("mask value outside [0, 1]")))
    if threshold is not None:
        v = (v > threshold).cast("int")
    if n_slots is not None:
        per_slot = [F.max(F.when(F.col(slot) == i, v)).alias(f"__s{i}") for i in range(n_slots)]
        table = F.array(*[F.col(f"__s{i}") for i in range(n_slots)])
        return soft.groupBy(*point).agg(*per_slot).select(*point, soft_array_to_hard(table).alias("class"))
    best = F.max(F.struct(v.alias("v"), (-F.col(slot)).alias("s")))
    return soft.groupBy(*point).agg(best.alias("__best")).select(
        *point, (-F.col("__best.s")).cast("long").alias("class")
    )


def soft_array_to_hard(values: Column, threshold: float | None = None) -> Column:
    """The same for slots held in one array: no shuffle."""
    if threshold is not None:
        values = F.transform(values, lambda v: (v > threshold).cast("double"))
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def dense_to_onehot(labels: DataFrame, label: str = "label", remove_zero: bool = False) -> DataFrame:
    """Long one-hot form: class = label, or label - 1 with the unlabelled zero removed."""
    if not remove_zero:
        return labels.withColumn("class", F.col(label).cast("long"))
    return labels.filter(F.col(label) > 0).withColumn("class", (F.col(label) - 1).cast("long"))


def onehot_array(label: Column, num_classes: int, remove_zero: bool = False) -> Column:
    first = 1 if remove_zero else 0
    classes = F.sequence(F.lit(first), F.lit(num_classes - 1 + first))
    return F.transform(classes, lambda c: c == label)


def instances_to_binary(values: Column, num_classes: int) -> Column:
    """Instance stack of one pixel as booleans, false-padded to `num_classes`."""
    binary = F.transform(values, lambda v: v != 0)
    missing = F.lit(num_classes) - F.size(values)
    return F.when(missing >= 0, F.concat(binary, F.array_repeat(F.lit(False), missing))).otherwise(
        F.raise_error(F.lit(f"more than {num_classes} instances"))
    )


def mask_validation(
    true: DataFrame,
    pred: DataFrame,
    sample: Sequence[str],
    point: Sequence[str],
    cls: str = "class",
    ignore_overlaps: bool = False,
    ignore_background: bool = False,
) -> DataFrame:
    """Per sample: points, and how many break each input rule of the metrics.

    Masks are long tables, so a repeated (point, class) row is a value other than 0/1.
    `ok` says whether the sample may be scored with the given options.
    """
    keys = [*sample, *point]

    def per_point(df: DataFrame, tag: str) -> DataFrame:
        classes = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("__rows"))
        return classes.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.max((F.col("__rows") > 1).cast("long")).alias(f"{tag}_repeat")
        )

    points = per_point(true, "true").join(per_point(pred, "pred"), keys, "full")
    zero = F.lit(0)
    n_true, n_pred = F.coalesce("n_true", zero), F.coalesce("n_pred", zero)
    report = points.groupBy(*sample).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(F.coalesce("true_repeat", zero)).alias("true_not_binary"),
        F.sum(F.coalesce("pred_repeat", zero)).alias("pred_not_binary"),
        F.sum((n_pred != 1).cast("long")).alias("pred_not_onehot"),
        F.sum((n_true > 1).cast("long")).alias("true_overlaps"),
        F.sum((n_true != 1).cast("long")).alias("true_not_onehot"),
    )
    bad = F.col("true_not_binary") + F.col("pred_not_binary") + F.col("pred_not_onehot")
    if not ignore_overlaps:
        bad = bad + F.col("true_overlaps")
    if ignore_background:
        bad = bad + F.col("true_not_onehot")
    return report.withColumn("ok", bad == 0)


def require_valid(report: DataFrame) -> DataFrame:
    """Passes the report through and fails the job on a sample that is not ok."""
    return report.withColumn(
        "ok",
        F.when(F.col("ok"), F.col("ok")).otherwise(F.raise_error(F.lit("masks break the metric's input rules"))),
    )


def overlap_points(true: DataFrame, keys: Sequence[str], cls: str = "class") -> DataFrame:
    """Points that more than one true class claims."""
    ends = true.groupBy(*keys).agg(F.min(cls).alias("__low"), F.max(cls).alias("__high"))
    return ends.filter("__low <> __high").select(*keys)


def drop_overlaps(
    true: DataFrame, pred: DataFrame, keys: Sequence[str], from_pred: bool, cls: str = "class"
) -> tuple[DataFrame, DataFrame]:
    """Removes multiply claimed points from the truth, and from the prediction when asked."""
    overlaps = overlap_points(true, keys, cls)
    kept_true = true.join(overlaps, list(keys), "left_anti")
    kept_pred = pred.join(overlaps, list(keys), "left_anti") if from_pred else pred
    return kept_true, kept_pred


def drop_background(true: DataFrame, cls: str = "class", background: int = 0) -> DataFrame:
    return true.filter(F.col(cls) != background)


def mask_boundaries(
    mask: DataFrame, keys: Sequence[str], height: int, width: int, ratio: float = 0.02
) -> DataFrame:
    """Set pixels that a (2d+1)^2 erosion removes; `keys` name one mask (sample, frame, class).

    The box is separable: a pixel survives when its row run is full over 2d+1
    columns and those row results are full over 2d+1 rows. Each window group is one
    pixel row or column of one mask, at most `width` or `height` rows.
    """
    d = boundary_dilation(height, width, ratio)
    across = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-d, d)
    down = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-d, d)
    rows = mask.withColumn("__full", (F.count(F.lit(1)).over(across) == 2 * d + 1).cast("int"))
    kept = rows.withColumn("__inner", F.sum("__full").over(down) == 2 * d + 1)
    return kept.filter(~F.col("__inner")).drop("__full", "__inner")


def resize_nearest(mask: DataFrame, in_size: tuple[int, int], out_size: tuple[int, int]) -> DataFrame:
    """Nearest (pixel-centre) resize of a mask.

    The coordinate map depends only on the sizes, so every source pixel carries the
    output coordinates that read it: two small explodes, no join.
    """
    (h, w), (out_h, out_w) = in_size, out_size

    def readers(coordinate: str, n_in: int, n_out: int) -> Column:
        near = F.floor(F.col(coordinate) * n_out / F.lit(n_in)).cast("long")
        span = int(n_out / n_in) + 2
        around = F.sequence(F.greatest(near - 1, F.lit(0)), F.least(near + span, F.lit(n_out - 1)))
        return F.filter(around, lambda o: nearest_source(o, n_in, n_out) == F.col(coordinate))

    return (
        mask.withColumn("__y", F.explode(readers("y", h, out_h)))
        .withColumn("__x", F.explode(readers("x", w, out_w)))
        .drop("y", "x")
        .withColumnsRenamed({"__y": "y", "__x": "x"})
    )


def slot_coverage(hard: DataFrame, frame_keys: Sequence[str], n_slots: int, cls: str = "class") -> DataFrame:
    """(frame, slot, coverage): share of the frame's pixels, zero for an absent slot.

    One counter per slot is kept in a single aggregation, so no slot grid is joined.
    """
    counts = [F.sum((F.col(cls) == s).cast("long")).alias(f"__c{s}") for s in range(n_slots)]
    per_frame = hard.groupBy(*frame_keys).agg(F.count(F.lit(1)).alias("__n"), *counts)
    table = F.array(*[F.col(f"__c{s}") for s in range(n_slots)])
    return per_frame.select(*frame_keys, "__n", F.posexplode(table).alias("slot", "__c")).select(
        *frame_keys, F.col("slot").cast("long").alias("slot"), (F.col("__c") / F.col("__n")).alias("coverage")
    )
