"""Masks as one packed label array a frame: class pairs and boundaries counted inside Arrow batches.

A label frame is one row with its keys and, for each side, a binary column of 32-bit labels in
row-major order: a class number, `NONE` where no class holds the point, `OVERLAP` where several do,
`ABSENT` where the frame has no such point (no pixel row): it counts nowhere and breaks no rule.
Scores need only how many points each pair of classes shares, so a frame leaves its task as a few
counts; no pixel is a row and none is shuffled. `pack_labels` makes label frames from pixel rows:
one list a frame and map task is shuffled. The counts have the columns of `metrics.class_cells`,
from which all scores go on.

A frame is the unit of work: its two arrays and a few arrays of the same size are in memory at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import boundary_dilation

NONE, OVERLAP, ABSENT = -1, -2, -3
BACKGROUND = 0


def scatter(at: np.ndarray, cls: np.ndarray, size: int) -> np.ndarray:
    """Labels of `size` points from (position, class) entries."""
    if len(at) and (at.min() < 0 or at.max() >= size):
        raise ValueError("a point lies outside the frame")
    if len(cls) and cls.min() < 0:
        raise ValueError("a class number is negative")
    held = np.bincount(at, minlength=size)
    labels = np.full(size, NONE, np.int32)
    labels[at] = cls
    if (held > 1).any():
        order = np.lexsort((cls, at))
        at, cls = at[order], cls[order]
        if ((at[1:] == at[:-1]) & (cls[1:] == cls[:-1])).any():
            raise ValueError("a class is repeated at a point")
        labels[held > 1] = OVERLAP
    return labels


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _map(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], made: Sequence[T.StructField], fn: Callable) -> DataFrame:
    """One frame row in, `fn(values of inputs)` rows of `made` out, behind the frame's keys."""
    schema = T.StructType([*_fields(df, keys), *made])
    names, kinds, n_keys = schema.fieldNames(), [f.dataType for f in made], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [{"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[k.simpleString()] for k in kinds]
        for batch in batches:
            rows, columns = [], [[] for _ in made]
            for i in range(batch.num_rows):
                found = fn(*(batch.column(n_keys + j)[i] for j in range(len(inputs))))
                rows += [i] * len(found[0])
                for column, values in zip(columns, found):
                    column.extend(values)
            own = [batch.column(j).take(pa.array(rows, pa.int64())) for j in range(n_keys)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(columns, arrow))], names)

    return df.select(*keys, *inputs).mapInArrow(run, schema)


def pack_labels(points: DataFrame, frame: Sequence[str], height: int, width: int, sides: dict[str, Column]) -> DataFrame:
    """(frame, one binary column for each side) from pixel rows with y and x; a null class holds nothing.

    A frame without rows has no row here, a point without rows is absent on all sides, and a repeated (point, class)
    fails the job.
    """
    entries = F.collect_list(
        F.struct((F.col("y") * width + F.col("x")).cast("long").alias("at"), *[c.cast("int").alias(name) for name, c in sides.items()])
    )
    grouped = points.groupBy(*frame).agg(entries.alias("__entries"))
    size, n_sides = height * width, len(sides)

    def pack(entries: pa.Scalar) -> list[list[bytes]]:
        rows = entries.values
        at = rows.field(0).to_numpy()
        if at.min() < 0 or at.max() >= size:
            raise ValueError("a point lies outside the frame")
        absent = np.bincount(at, minlength=size) == 0
        out = []
        for side in range(1, n_sides + 1):
            cls = rows.field(side)
            held = np.asarray(cls.is_valid())
            labels = scatter(at[held], cls.drop_null().to_numpy(), size)
            labels[absent] = ABSENT
            out.append([labels.tobytes()])
        return out

    return _map(grouped, frame, ["__entries"], [T.StructField(name, T.BinaryType()) for name in sides], pack)


def checked(true: np.ndarray, pred: np.ndarray, ignore_overlaps: bool, ignore_background: bool, one_pred: bool = True) -> None:
    """Fails where the input rules of the scores are broken."""
    if (pred == OVERLAP).any():
        raise ValueError("predicted classes overlap")
    if one_pred and ((pred == NONE) | (pred == ABSENT) & (true != ABSENT)).any():
        raise ValueError("a point has no predicted class")
    if not ignore_overlaps and (true == OVERLAP).any():
        raise ValueError("true classes overlap")
    if ignore_background and ((true == NONE) | (true == ABSENT) & (pred != ABSENT)).any():
        raise ValueError("a point has no true class")


def present(true: np.ndarray, pred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels of the points that either side has."""
    has = (true != ABSENT) | (pred != ABSENT)
    return tuple(np.where(x == ABSENT, NONE, x)[has] for x in (true, pred))


def pair_counts(true: np.ndarray, pred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(true label, predicted label, points) of every pair that occurs."""
    low, wide = ABSENT, int(pred.max(initial=NONE)) - ABSENT + 1
    keys, n = np.unique((true.astype(np.int64) - low) * wide + (pred - low), return_counts=True)
    return keys // wide + low, keys % wide + low, n


def _labels(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32)


def _nullable(labels: np.ndarray) -> list[int | None]:
    return [None if c < 0 else c for c in labels.tolist()]


def class_cells(
    frames: DataFrame,
    frame: Sequence[str],
    sample: Sequence[str],
    true: str = "true",
    pred: str = "pred",
    ignore_overlaps: bool = False,
    ignore_background: bool = False,
    overlaps_leave_pred: bool = False,
) -> DataFrame:
    """(sample, true_class, pred_class, n, labelled), as `metrics.class_cells` gives them.

    Input rules: exactly one predicted class at every point; true classes don't overlap, unless that is ignored; and with
    `ignore_background` every point has a true class. A frame that breaks one fails the job.
    """

    def count(t: pa.Scalar, p: pa.Scalar) -> list[list]:
        t, p = _labels(t), _labels(p)
        checked(t, p, ignore_overlaps, ignore_background)
        own, other, n = pair_counts(*present(t, p))
        if overlaps_leave_pred:
            other = np.where(own == OVERLAP, NONE, other)
        return [_nullable(own), _nullable(other), n.tolist(), (own != NONE).tolist()]

    made = [T.StructField(n, T.LongType()) for n in ("true_class", "pred_class", "n")] + [T.StructField("labelled", T.BooleanType())]
    counts = _map(frames, frame, [true, pred], made, count)
    return counts.groupBy(*sample, "true_class", "pred_class").agg(F.sum("n").alias("n"), F.max("labelled").alias("labelled"))


def boundaries(labels: np.ndarray, d: int) -> np.ndarray:
    """The labels of points that a (2d+1)^2 erosion of their class removes, `NONE` elsewhere; labels: (height, width).

    The box is separable: the least and the greatest label over 2d+1 columns, then over 2d+1 rows. Outside counts as another class.
    """
    low = high = labels
    for axis in (1, 0):
        room = [(0, 0), (0, 0)]
        room[axis] = (d, d)
        lows, highs = (np.pad(x, room, constant_values=OVERLAP) for x in (low, high))
        view = [np.lib.stride_tricks.sliding_window_view(x, 2 * d + 1, axis) for x in (lows, highs)]
        low, high = view[0].min(axis=-1), view[1].max(axis=-1)
    return np.where((low == high) & (low == labels) | (labels < 0), NONE, labels).astype(np.int32)


def mask_boundaries(frames: DataFrame, frame: Sequence[str], side: str, height: int, width: int, ratio: float = 0.02) -> DataFrame:
    """(frame, side): the side's boundaries as labels."""
    d = boundary_dilation(height, width, ratio)

    def edges(labels: pa.Scalar) -> list[list[bytes]]:
        return [[boundaries(_labels(labels).reshape(height, width), d).tobytes()]]

    return _map(frames, frame, [side], [T.StructField(side, T.BinaryType())], edges)


def pixels(frames: DataFrame, frame: Sequence[str], side: str, width: int) -> DataFrame:
    """(frame, y, x, class) of every point that has one class: the way back to pixel rows."""

    def rows(labels: pa.Scalar) -> list[list[int]]:
        labels = _labels(labels)
        at = np.flatnonzero(labels >= 0)
        return [(at // width).tolist(), (at % width).tolist(), labels[at].tolist()]

    return _map(frames, frame, [side], [T.StructField(n, T.LongType()) for n in ("y", "x", "class")], rows)


def scores_of(true: np.ndarray, pred: np.ndarray, ignore_background: bool) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(true class, predicted class): (shared points, points of the true class, points of the predicted class)}"""
    own, other, n = pair_counts(true, pred)
    n_true, n_pred = np.bincount(true[true >= 0]), np.bincount(pred[pred >= 0])
    keep = (own >= 0) & (other >= 0) & ~(ignore_background & (own == BACKGROUND))
    return {(t, p): (int(k), int(n_true[t]), int(n_pred[p])) for t, p, k in zip(own[keep].tolist(), other[keep].tolist(), n[keep].tolist())}


def region_and_boundary(
    frames: DataFrame,
    frame: Sequence[str],
    height: int,
    width: int,
    true: str = "true",
    pred: str = "pred",
    ignore_background: bool = False,
    ignore_overlaps: bool = False,
) -> DataFrame:
    """(frame, true_class, pred_class, iou, precision, recall, f_measure, shared) in one pass over the frames.

    A row for each pair that shares a point, of the masks or of their boundaries (0 in the other), and one with a null
    predicted class for each true class; besides, each frame has one row of nulls, by which frames are counted.
    Points with several true classes leave both sides when they are ignored.
    """
    d = boundary_dilation(height, width)

    def scores(t: pa.Scalar, p: pa.Scalar) -> list[list]:
        t, p = _labels(t), _labels(p)
        checked(t, p, ignore_overlaps, ignore_background)
        t, p = np.where(t == OVERLAP, NONE, t), np.where(t == OVERLAP, NONE, p)
        region = scores_of(t, p, ignore_background)
        edges = [boundaries(x.reshape(height, width), d).reshape(-1) for x in (t, p)]
        contour = scores_of(*edges, ignore_background)
        rows = []
        for pair in sorted(region.keys() | contour.keys()):
            k, n_true, n_pred = region.get(pair, (0, 1, 1))
            edge, e_true, e_pred = contour.get(pair, (0, 1, 1))
            precision, recall = edge / e_pred, edge / e_true
            f = 2 * precision * recall / (precision + recall) if edge else 0.0
            rows.append((*pair, k / (n_true + n_pred - k), precision, recall, f, edge > 0))
        classes = [c for c in np.unique(t[t >= 0]).tolist() if not (ignore_background and c == BACKGROUND)]
        rows += [(c, None, None, None, None, None, None) for c in [*classes, None]]
        return [list(c) for c in zip(*rows)]

    made = [T.StructField(n, T.LongType()) for n in ("true_class", "pred_class")]
    made += [T.StructField(n, T.DoubleType()) for n in ("iou", "precision", "recall", "f_measure")] + [T.StructField("shared", T.BooleanType())]
    return _map(frames, frame, [true, pred], made, scores)
