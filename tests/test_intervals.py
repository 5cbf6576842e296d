"""Points in ranges against a double loop, and draws located among episodes against drawn frames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framelake.operators import episodes as ops
from framelake.operators import mixing
from framelake.operators.intervals import interval_join
from framelake.plans import episodes as plans


def brute(points, ranges):
    return sorted(
        (k, at, name)
        for k, at in points
        for k2, low, high, name in ranges
        if None not in (k, at, low, high) and k == k2 and low <= at < high
    )


def joined(spark, points, ranges, width):
    left = spark.createDataFrame(points, "k long, at long")
    right = spark.createDataFrame(ranges, "k long, low long, high long, name long")
    return sorted(map(tuple, interval_join(left, right, ["k"], "at", "low", "high", width).select("k", "at", "name").collect()))


@pytest.mark.parametrize("width", [1, 7, 64, 5000])
def test_equals_a_double_loop(spark, width):
    draw = random.Random(5)
    points = [(draw.randrange(3), draw.randrange(-400, 400)) for _ in range(300)] + [(0, 3)] * 200
    ranges = []
    for name in range(60):
        low = draw.randrange(-400, 400)
        ranges.append((draw.randrange(3), low, low + draw.choice([0, 1, 5, 64, 300]), name))
    points += [(None, 1), (1, None)]
    ranges += [(None, -500, 500, 90), (0, None, 5, 91), (0, 5, None, 92), (0, 9, 2, 93), (2, -400, 400, 94), (2, -400, 400, 94)]
    assert joined(spark, points, ranges, width) == brute(points, ranges)


def test_empty_sides_and_clashing_names(spark):
    assert joined(spark, [], [(0, 0, 5, 1)], 8) == [] == joined(spark, [(0, 1)], [], 8)
    both = spark.createDataFrame([(0, 1, 2)], "k long, at long, low long")
    with pytest.raises(ValueError, match="low"):
        interval_join(both, both.withColumnRenamed("at", "high"), ["k"], "at", "low", "high")


def test_a_hot_range_is_spread_over_cells(spark):
    """One range with nearly all points: its points meet it in as many groups as it has cells."""
    points = spark.range(20_000).select(F.lit(0).cast("long").alias("k"), F.col("id").alias("at"))
    ranges = spark.createDataFrame([(0, 0, 19_000, 1), (0, 19_000, 20_000, 2)], "k long, low long, high long, name long")
    found = interval_join(points, ranges, ["k"], "at", "low", "high")
    assert {(r.name, r["count"]) for r in found.groupBy("name").count().collect()} == {(1, 19_000), (2, 1_000)}


def test_the_same_draws_as_from_the_frames(spark):
    lengths = [(0, e, n) for e, n in enumerate([3, 0, 200, 1, 1, 1, 70])] + [(1, e, n) for e, n in enumerate([5, 9])]
    plan = spark.createDataFrame(lengths, "dataset_index long, episode_index long, length long")
    bounds = ops.episode_offsets(plan, ["dataset_index"])
    frames = bounds.filter("length > 0").select(
        "dataset_index", "episode_index", F.posexplode(F.sequence("dataset_from_index", F.col("dataset_to_index") - 1)).alias("frame_index", "local_index")
    )
    columns = ["draw", "dataset_index", "episode_index", "frame_index"]
    by_frames = mixing.weighted_sample(spark, frames, 3000, (0.25, 0.75), seed=9).select(*columns)
    by_ranges = mixing.weighted_frames(spark, bounds, 3000, (0.25, 0.75), seed=9).select(*columns)
    assert sorted(map(tuple, by_ranges.collect())) == sorted(map(tuple, by_frames.collect()))
    with pytest.raises(Exception, match="empty dataset"):
        mixing.weighted_frames(spark, bounds.filter("dataset_index = 0"), 10, (0.5, 0.5)).collect()


def test_the_query_moves_no_frames(spark, sf):
    plan = plans.weighted_sample(spark, sf)._jdf.queryExecution().executedPlan().toString()
    # a subquery is printed with each use, but planned and run once
    exchanges = set(re.findall(r"Exchange .*plan_id=(\d+)", plan))
    assert len(exchanges) <= 8 and "conversations" not in plan and "lineitem" not in plan
