"""Run-length masks by their runs against the same by their pixels."""

import random
import time

from pyspark.sql import functions as F

from framelake.operators import annotations as ops

SCHEMA = "id long, counts array<bigint>, other array<bigint>"


def pixels(counts):
    at, found = 0, set()
    for place, length in enumerate(counts):
        if place % 2:
            found.update(range(at, at + length))
        at += length
    return found


def masks(seed, n=200):
    draw = random.Random(seed)
    some = lambda: [draw.choice([0, 0, 1, 2, 5, 17]) for _ in range(draw.randrange(9))]
    return [(i, some(), some()) for i in range(n)] + [(900, [], []), (901, [0, 0], [4]), (902, [0, 30], [0, 30])]


def test_boxes_equal_those_of_the_pixels(spark):
    rows, h = masks(3), 5
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r.id: tuple(r)[1:] for r in ops.rle_boxes(frame, ["id"], F.lit(h)).collect()}
    for i, counts, _ in rows:
        points = [(p // h, p % h) for p in pixels(counts)]
        if not points:
            assert found[i] == (0, 0, 0, 0, 0)
            continue
        xs, ys = zip(*points)
        assert found[i] == (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(points))


def test_overlaps_equal_those_of_the_pixels(spark):
    rows = masks(4)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r.id: tuple(r.o) for r in frame.select("id", ops.rle_overlap("counts", "other").alias("o")).collect()}
    for i, one, other in rows:
        assert found[i] == (len(pixels(one) & pixels(other)), len(pixels(one) | pixels(other))), (one, other)


def test_starts_and_nulls(spark):
    frame = spark.createDataFrame([(1, [2, 3, 4], None), (2, None, [1, 1]), (3, [], [1]), (4, [1, None, 2, 5], [None])], SCHEMA)
    starts = {r.id: r.s for r in frame.coalesce(1).select("id", ops.rle_starts("counts").alias("s")).collect()}
    assert starts == {1: [0, 2, 5], 2: None, 3: [], 4: [0, 1, None, None]}
    assert {r.o for r in frame.filter("id <> 3").select(ops.rle_overlap("counts", "other").alias("o")).collect()} == {None}
    boxes = {r.id: tuple(r)[1:] for r in ops.rle_boxes(frame, ["id"], F.lit(2)).collect()}
    assert boxes[2] == (None,) * 5 and boxes[3] == (0,) * 5
    assert sorted(map(tuple, ops.rle_runs(frame, ["id"]).filter("run_length > 0").collect())) == [(1, 2, 3), (4, None, 5)]


def test_long_rows_take_linear_time(spark):
    def seconds(n):
        row = spark.range(1).select(F.col("id"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i % 5).alias("counts"))
        begin = time.time()
        total = ops.rle_runs(row, ["id"]).agg(F.sum("run_length"), F.max("run_start")).first()
        assert total[0] == sum(i % 5 for i in range(2, n + 1, 2)) and total[1] == sum(i % 5 for i in range(1, n))
        return time.time() - begin

    seconds(1_000)
    # a fold that copies its array would take minutes here
    assert seconds(400_000) < 20


def test_overlaps_of_a_batch_are_those_of_its_rows_and_take_no_loop():
    import time

    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    one, other = ([draw.integers(0, 5, draw.integers(0, 9)).tolist() if draw.random() < 0.9 else None for _ in range(500)] for _ in range(2))

    def plain(pair):
        if None in pair:
            return None
        sets = [{at for i, c in enumerate(counts) if i % 2 for at in range(sum(counts[:i]), sum(counts[:i]) + c)} for counts in pair]
        return {"intersection": len(sets[0] & sets[1]), "union": len(sets[0] | sets[1])}

    kind = pa.list_(pa.int64())
    found = ops.rle_overlap.func(pa.array(one, kind), pa.array(other, kind))
    assert found.to_pylist() == [plain(pair) for pair in zip(one, other)]
    part = ops.rle_overlap.func(pa.array(one, kind).slice(100, 50), pa.array(other, kind).slice(100, 50))
    assert part.to_pylist() == found.to_pylist()[100:150]
    many = pa.array([[1, 2, 3, 4]] * 100_000, kind)
    start = time.process_time()
    ops.rle_overlap.func(many, many)
    assert time.process_time() - start < 2.0
