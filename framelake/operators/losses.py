"""Losses between stored vectors, and weighted totals of named losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import array_sum, as_doubles, log_softmax


def squared_error(a, b) -> Column:
    return array_sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)))


def reconstruction_mse(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(
        (F.sum(squared_error(a, b)) / F.sum(F.size(F.col(a)))).alias("mse")
    )


def soft_cross_entropy(rows: DataFrame, logits: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cross-entropy against a target distribution, averaged over the positions.

    Where one array is shorter, the other's further entries add nothing.
    """
    n = F.least(F.size(F.col(logits)), F.size(F.col(target)))
    own, other = F.slice(log_softmax(logits), 1, n), F.slice(as_doubles(target), 1, n)
    per_row = -array_sum(F.zip_with(own, other, lambda lp, t: lp * t))
    return rows.groupBy(*keys).agg(F.avg(per_row).alias("cross_entropy"))


def weighted_total(losses: DataFrame, weights: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """(keys, total): weighted sum of the named losses; zero weights and their losses drop out.

    Every loss needs a weight; an unnamed one fails the job.
    """
    weight = F.lit(None).cast("double")
    for name, value in weights.items():
        weight = F.when(F.col("loss") == name, F.lit(float(value))).otherwise(weight)
    checked = losses.withColumn("__w", weight).withColumn(
        "__w",
        F.when(F.col("__w").isNotNull(), F.col("__w")).otherwise(
            F.raise_error(F.concat(F.lit("no weight for loss "), F.col("loss")))
        ),
    )
    return checked.filter(F.col("__w") != 0).groupBy(*keys).agg(F.sum(F.col("value") * F.col("__w")).alias("total"))


def epoch_mean(batches: DataFrame, value: str, size: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over an epoch, batches weighted by their size."""
    return batches.groupBy(*keys).agg((F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias("epoch_mean"))
