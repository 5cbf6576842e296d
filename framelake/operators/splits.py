"""Train / validation / test splits of episodes, and checks of explicit lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, seeded_digest
from .numbering import dense_index


def row_count(rows: DataFrame) -> Column:
    return rows.agg(F.count(F.lit(1))).scalar()


def split_size(n: Column, fraction: Column) -> Column:
    """max(1, n * fraction rounded half to even), 0 for a zero fraction."""
    return F.when(fraction > 0, F.greatest(F.lit(1), F.bround(n * fraction).cast("long"))).otherwise(0)


def split_by_fraction(
    episodes: DataFrame,
    val_fraction: float | Column,
    test_fraction: float | Column,
    seed: int | Column = 0,
    keys: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Adds split: in hash order, first the validation episodes, then test, the rest train.

    `keys` names the dataset columns that are split on their own. A dataset whose
    fractions leave no training episode is an error (`strict`).
    """
    val = val_fraction if isinstance(val_fraction, Column) else F.lit(float(val_fraction))
    test = test_fraction if isinstance(test_fraction, Column) else F.lit(float(test_fraction))
    seed_text = (seed if isinstance(seed, Column) else F.lit(seed)).cast("string")
    digest = F.md5(F.concat_ws(":", seed_text, F.col("episode_index").cast("string")).cast("binary"))
    hashed = episodes.withColumn("__digest", digest)
    ranked = dense_index(
        hashed,
        ["__digest", "episode_index"],
        hash_bucket(F.col("__digest"), row_count(episodes)),
        "__rank",
        partition=keys,
        total_out="__n",
    )
    n_val, n_test = split_size(F.col("__n"), val), split_size(F.col("__n"), test)
    split = (
        F.when(F.col("__rank") < n_val, "val")
        .when(F.col("__rank") < n_val + n_test, "test")
        .otherwise("train")
    )
    if strict:
        split = F.when(
            (n_val + n_test > 0) & (n_val + n_test >= F.col("__n")),
            F.raise_error(F.lit("split fractions leave no training episode")),
        ).otherwise(split)
    return ranked.withColumn("split", split).drop("__digest", "__rank", "__n")


def split_explicit(
    episodes: DataFrame,
    explicit: DataFrame,
    val_fraction: float = 0.0,
    test_fraction: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """Splits named in `explicit` (split, episode_index) win; fractions divide what remains.

    With an explicit train list only its episodes are divided; otherwise all the
    unreserved ones are. A split given explicitly takes no fraction.
    """
    given = explicit.groupBy("split").agg(F.count(F.lit(1)).alias("n"))

    def is_given(name: str) -> Column:
        return F.coalesce(given.filter(F.col("split") == name).select(F.max("n")).scalar(), F.lit(0)) > 0

    reserved = explicit.filter(F.col("split") != "train").select("episode_index", "split")
    named_train = explicit.filter(F.col("split") == "train").select("episode_index", F.lit(True).alias("__named"))
    free = (
        episodes.join(reserved, "episode_index", "left_anti")
        .join(named_train, "episode_index", "left")
        .filter(F.col("__named").isNotNull() | ~is_given("train"))
        .drop("__named")
    )
    divided = split_by_fraction(
        free,
        F.when(is_given("val"), 0.0).otherwise(val_fraction),
        F.when(is_given("test"), 0.0).otherwise(test_fraction),
        seed,
    )
    return divided.unionByName(episodes.join(reserved, "episode_index"))


def split_overlap(assigned: DataFrame) -> DataFrame:
    """(left_split, right_split, episode_index) for episodes named in two splits; expected empty.

    The splits of an episode are gathered first, so no pair of rows is formed.
    """
    names = assigned.groupBy("episode_index").agg(F.array_sort(F.collect_set("split")).alias("names"))
    pairs = F.flatten(
        F.transform(
            "names",
            lambda a, i: F.transform(
                F.slice("names", i + 2, F.size("names")),
                lambda b: F.struct(a.alias("left_split"), b.alias("right_split")),
            ),
        )
    )
    return (
        names.filter(F.size("names") > 1)
        .select("episode_index", F.explode(pairs).alias("pair"))
        .select("pair.left_split", "pair.right_split", "episode_index")
    )


def episodes_except(episodes: DataFrame, reserved: DataFrame) -> DataFrame:
    return episodes.join(reserved.select("episode_index"), "episode_index", "left_anti")


def episodes_union(assigned: DataFrame) -> DataFrame:
    """Distinct episodes of all splits."""
    return assigned.select("episode_index").distinct()


def episode_list_checks(explicit: DataFrame, total: int | Column) -> DataFrame:
    """(episode_index, problem) for ids listed twice in a split or outside [0, total)."""
    total = F.lit(total) if isinstance(total, int) else total
    counted = explicit.groupBy("split", "episode_index").agg(F.count(F.lit(1)).alias("copies"))
    outside = (F.col("episode_index") < 0) | (F.col("episode_index") >= total)
    return counted.select(
        "split",
        "episode_index",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("copies") > 1, "duplicate"), F.when(outside, "out_of_range")
                )
            )
        ).alias("problem"),
    )


def tail_split(rows: DataFrame, key: str, n_tail: int, bucket: Column) -> DataFrame:
    """Adds split: the last `n_tail` keys are val, the others train."""
    indexed = dense_index(rows, [key], bucket, "__position", total_out="__n")
    return indexed.withColumn(
        "split", F.when(F.col("__position") >= F.col("__n") - n_tail, "val").otherwise("train")
    ).drop("__position", "__n")


def split_sizes(rows: DataFrame, keys: Sequence[str] = ("dataset_index", "split")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))


def hash_order(rows: DataFrame, seed: int, keys: Sequence[str], out: str = "position") -> DataFrame:
    """Adds the position of every row in a seeded shuffle of the whole table."""
    hashed = rows.withColumn("__digest", seeded_digest(seed, *keys))
    return dense_index(
        hashed, ["__digest", *keys], hash_bucket(F.col("__digest"), row_count(rows)), out
    ).drop("__digest")
