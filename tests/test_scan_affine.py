"""Composed affine steps against a plain loop."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from framelake.operators import scans
from framelake.plans import frames as plans


def loop(rows, initial=0.0, first=None):
    """rows: (key, order, factor, shift); first: (factor, shift) of a first step from its own."""
    out, held = [], defaultdict(list)
    for row in rows:
        held[row[0]].append(row)
    for key, own in held.items():
        state = initial
        for n, (_, at, a, b) in enumerate(sorted(own, key=lambda r: r[1])):
            a, b = first(a, b) if first and n == 0 else (a, b)
            after = None if state is None or a is None or b is None else a * state + b
            out.append((key, at, state, after))
            state = after
    return sorted(out, key=lambda r: r[:2])


def check(spark, rows, initial=0.0, first=None, columns=None, **options):
    df = spark.createDataFrame(rows, "k string, t long, a double, b double").repartition(5)
    got = scans.scan_affine(df, ["k"], "t", F.col("a"), F.col("b"), initial, columns, **options).collect()
    got = sorted(((r.k, r.t, r.state, r.state_next) for r in got), key=lambda r: r[:2])
    expected = loop(rows, initial, first)
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    for own, other in zip(got, expected):
        for x, y in zip(own[2:], other[2:]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9))


def drawn(draw, key, n, gaps=1):
    at = 0
    for _ in range(n):
        at += draw.randint(1, gaps)
        yield key, at, draw.uniform(-1, 1), draw.uniform(-5, 5)


@pytest.mark.parametrize("width", [2, 5, 64])
def test_a_hot_sequence_and_many_short_ones(spark, width):
    draw = random.Random(width)
    rows = [*drawn(draw, "hot", 700, 9), *(r for i in range(40) for r in drawn(draw, f"k{i}", draw.randint(1, 12), 300))]
    check(spark, rows, 2.5, width=width)


def test_another_first_step(spark):
    rows = [*drawn(random.Random(1), "x", 90, 4), ("y", 0, 0.5, 3.0)]
    check(spark, rows, 7.0, lambda a, b: (0.0, b), (F.lit(0.0), F.col("b")), width=8)


def test_null_steps_and_empty_tables(spark):
    rows = [("x", t, None if t == 5 else 0.5, 1.0) for t in range(12)] + [("y", 3, 1.0, None), ("y", 200, 1.0, 1.0)]
    check(spark, rows, width=4)
    empty = spark.createDataFrame([], "k string, t long, a double, b double")
    assert scans.scan_affine(empty, ["k"], "t", F.col("a"), F.col("b")).count() == 0


def test_the_query_runs_no_python(spark, sf):
    plan = plans.scan_over_time_affine(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
