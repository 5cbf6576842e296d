"""Dense numbers and running offsets over whole tables without a one-task window.

Rows are grouped into buckets that follow the requested order, within each
partition key if there is one. Only the bucket totals are chained; the rows
themselves are numbered per bucket, so the largest task holds one bucket, whatever
share of the rows a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import div

_BUCKET, _BASE = "__bucket", "__base"


def _bucket_bases(
    tagged: DataFrame, total: Column, partition: Sequence[str], total_out: str | None = None
) -> DataFrame:
    group = Window.partitionBy(*partition)
    window = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*partition, _BUCKET).agg(total.alias("__total"))
    if total_out is not None:
        totals = totals.withColumn(total_out, F.sum("__total").over(group))
    return totals.withColumn(_BASE, F.coalesce(F.sum("__total").over(window), F.lit(0))).drop("__total")


def exclusive_prefix_sum(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    bucket: Column,
    out: str,
    partition: Sequence[str] = (),
) -> DataFrame:
    """Adds the sum of `value` over all earlier rows; `bucket` must be monotone in `order`."""
    tagged = df.withColumn(_BUCKET, bucket)
    inside = (
        Window.partitionBy(*partition, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = tagged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    bases = _bucket_bases(tagged, F.sum(value), partition)
    return (
        numbered.join(bases, [*partition, _BUCKET])
        .withColumn(out, F.col(_BASE) + F.col(out))
        .drop(_BUCKET, _BASE)
    )


def dense_index(
    df: DataFrame,
    order: Sequence[str | Column],
    bucket: Column,
    out: str = "row_id",
    partition: Sequence[str] = (),
    total_out: str | None = None,
) -> DataFrame:
    """Adds a dense zero-based index in `order`; `bucket` must be monotone in `order`.

    `total_out` also adds the row count of the partition, which the bucket totals hold.
    Rows with a null partition key or bucket belong to no order and are left out.
    """
    tagged = df.withColumn(_BUCKET, bucket)
    inside = Window.partitionBy(*partition, _BUCKET).orderBy(*order)
    numbered = tagged.withColumn(out, F.row_number().over(inside) - 1)
    bases = _bucket_bases(tagged, F.count(F.lit(1)), partition, total_out)
    return (
        numbered.join(bases, [*partition, _BUCKET])
        .withColumn(out, (F.col(_BASE) + F.col(out)).cast("long"))
        .drop(_BUCKET, _BASE)
    )


def int_bucket(column: str, width: int = 65536) -> Column:
    """Bucket of an integer key; with unique keys it never holds more than `width` rows."""
    return div(column, width)
