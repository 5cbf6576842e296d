"""Mixing several datasets: tagged union, per-dataset options, weighted draws."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from .intervals import interval_join


def mixed_union(children: Sequence[DataFrame], tag: str = "dataset_index") -> DataFrame:
    """Union by name with the position of the child as tag; absent columns become null."""
    if not children:
        raise ValueError("no dataset to mix")
    tagged = [df.withColumn(tag, F.lit(i).cast("long")) for i, df in enumerate(children)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def mixed_overrides(children: DataFrame, parent: dict[str, object]) -> DataFrame:
    """Child options with the parent's value wherever a child sets none."""
    return children.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in children.columns else F.lit(value)
            for name, value in parent.items()
        }
    )


def weighted_dataset(u: Column, weights: Sequence[float]) -> Column:
    """Dataset whose cumulative weight interval [lo, hi) holds u in [0, 1).

    The intervals are options of the call, so the range join is a column expression.
    """
    total = float(sum(weights))
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must be non-negative with a positive sum")
    bounds = [b / total for b in accumulate(weights)][:-1]
    index = F.lit(0).cast("long")
    for bound in bounds:
        index = index + (u >= F.lit(bound)).cast("long")
    return index


def weighted_sample(
    spark: SparkSession,
    rows: DataFrame,
    n_draws: int | Column,
    weights: Sequence[float] | None = None,
    n_datasets: int | None = None,
    seed: int = 0,
    draws: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """`n_draws` rows with replacement: a dataset by weight, then a row of it uniformly.

    `rows` has dataset_index and a dense position inside the dataset
    (`local_index`). Draws are a distributed range; they meet the rows in an equi
    join on (dataset_index, local_index). `sizes` (dataset_index, size) saves counting
    the rows. An empty dataset is an error.
    """
    if sizes is None:
        sizes = rows.groupBy("dataset_index").agg(F.count(F.lit(1)).alias("size"))
    located = _located_draws(spark, sizes, n_draws, weights, n_datasets, seed, draws)
    return located.join(rows, ["dataset_index", "local_index"])


def weighted_frames(
    spark: SparkSession,
    episodes: DataFrame,
    n_draws: int | Column = 0,
    weights: Sequence[float] | None = None,
    n_datasets: int | None = None,
    seed: int = 0,
    draws: DataFrame | None = None,
) -> DataFrame:
    """(draw columns, dataset_index, episode_index, frame_index): the draws of `weighted_sample`, frames unseen.

    `episodes` gives the range of each episode's frames in its dataset (`dataset_from_index`, `dataset_to_index`) and
    covers it without gaps. A drawn position is looked up among the ranges by an interval join, so no
    frame table is read, numbered or shuffled; the work grows with draws and episodes.
    """
    sizes = episodes.groupBy("dataset_index").agg(F.max("dataset_to_index").alias("size")).filter("size > 0")
    located = _located_draws(spark, sizes, n_draws, weights, n_datasets, seed, draws)
    ranges = episodes.select("dataset_index", "episode_index", "dataset_from_index", "dataset_to_index")
    met = interval_join(located, ranges, ["dataset_index"], "local_index", "dataset_from_index", "dataset_to_index")
    frame = F.col("local_index") - F.col("dataset_from_index")
    return met.withColumn("frame_index", frame).drop("local_index", "dataset_from_index", "dataset_to_index")


def _located_draws(
    spark: SparkSession,
    sizes: DataFrame,
    n_draws: int | Column,
    weights: Sequence[float] | None,
    n_datasets: int | None,
    seed: int,
    draws: DataFrame | None,
) -> DataFrame:
    """Draws with their dataset and the position in it."""
    if weights is None:
        if n_datasets is None:
            raise ValueError("give weights or the number of datasets")
        weights = [1.0] * n_datasets
    if draws is None:
        draws = spark.range(n_draws).withColumnRenamed("id", "draw")
    # One entry per configured dataset, so the sizes travel as a map and draws are not shuffled for them.
    entries = F.map_from_entries(F.collect_list(F.struct("dataset_index", "size")))
    draws = draws.withColumn("__sizes", sizes.agg(entries).scalar())
    known = F.col("__sizes")
    size = F.try_element_at(known, F.col("dataset_index"))
    # every configured dataset needs rows, whether or not a draw meets it
    configured = F.array(*[F.lit(i).cast("long") for i in range(len(weights))])
    filled = F.size(F.array_except(configured, F.map_keys(known))) == 0
    picked = draws.withColumn("dataset_index", weighted_dataset(hash_uniform(seed, "draw"), weights))
    return picked.withColumn(
        "local_index",
        F.when(
            filled & size.isNotNull(), F.floor(hash_uniform(seed, "draw", offset=1) * size).cast("long")
        ).otherwise(F.raise_error(F.lit("cannot sample from an empty dataset"))),
    ).drop("__sizes")
