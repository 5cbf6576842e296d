"""Functions over one array column, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_doubles(vector) -> Column:
    return _col(vector).cast("array<double>")


def array_sum(vector) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0), lambda acc, x: acc + x)


def dot(left, right) -> Column:
    return array_sum(F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: a * b))


def l2_norm(vector) -> Column:
    return F.sqrt(array_sum(F.transform(as_doubles(vector), lambda x: x * x)))


def let(value, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row.

    The body of an array function runs per element and re-evaluates every
    expression in it; a value that does not depend on the element is bound here.
    """
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def l2_normalize(vector) -> Column:
    def scaled(v: Column) -> Column:
        return let(F.greatest(l2_norm(v), F.lit(NORM_FLOOR)), lambda n: F.transform(v, lambda x: x / n))

    return let(as_doubles(vector), scaled)


def slice_range(vector, start: int, stop: int) -> Column:
    """Elements [start, stop) counted from zero; a range outside the vector is an error."""
    vector = _col(vector)
    if not 0 <= start < stop:
        raise ValueError(f"invalid slice [{start}, {stop})")
    return F.when(F.size(vector) >= stop, F.slice(vector, start + 1, stop - start)).otherwise(
        F.raise_error(F.concat(F.lit(f"slice [{start}, {stop}) exceeds vector size "), F.size(vector)))
    )


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def softmax(logits) -> Column:
    """Softmax over the finite entries; an array without any becomes uniform."""

    def weights(values: Column) -> Column:
        # Without a finite entry the peak is null and every weight is one.
        peak = F.array_max(F.filter(values, finite))
        return let(
            peak,
            lambda top: F.transform(
                values,
                lambda x: F.when(top.isNull(), F.lit(1.0)).when(finite(x), F.exp(x - top)).otherwise(F.lit(0.0)),
            ),
        )

    def shares(w: Column) -> Column:
        return let(array_sum(w), lambda total: F.transform(w, lambda x: x / total))

    return let(let(as_doubles(logits), weights), shares)


def log_softmax(logits) -> Column:
    def shifted(values: Column) -> Column:
        return let(F.array_max(values), lambda top: F.transform(values, lambda x: x - top))

    def normalized(values: Column) -> Column:
        log_total = F.log(array_sum(F.transform(values, F.exp)))
        return let(log_total, lambda total: F.transform(values, lambda x: x - total))

    return let(let(as_doubles(logits), shifted), normalized)


def argmax(values) -> Column:
    """Zero-based position of the largest entry, the lowest one on ties."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def at(values, index: Column) -> Column:
    return F.element_at(_col(values), (index + 1).cast("int"))


def rank_of(values, index: Column) -> Column:
    """How many entries come before `index` when sorted by value, descending, then by position."""
    values = _col(values)

    def ahead_of(pivot: Column) -> Column:
        ahead = F.transform(
            values,
            lambda v, i: ((v > pivot["value"]) | ((v == pivot["value"]) & (i < pivot["at"]))).cast("long"),
        )
        return F.aggregate(ahead, F.lit(0).cast("long"), lambda acc, hit: acc + hit)

    return let(F.struct(at(values, index).alias("value"), index.alias("at")), ahead_of)
