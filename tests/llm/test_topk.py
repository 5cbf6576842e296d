"""Top-k lists against all inner products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import topk


def brute(rows, k=20):
    """rows: (vec_id, vector or None); lists by query row."""
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and fine(v)]
    out = []
    for at, (query_id, query) in enumerate(kept):
        if query_id % 20 == 0:
            scored = [(-sum(a * b for a, b in zip(query, v)), i) for other, (i, v) in enumerate(kept) if other != at]
            out += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(frame, **options):
    return sorted(tuple(r) for r in topk.search(frame, **options).collect())


def vectors(seed, n, dims=12):
    draw = np.random.default_rng(seed)
    matrix = draw.normal(size=(n, dims))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    return [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]


@pytest.mark.parametrize("block,chunk", [(50, 3), (32_768, 512)])
def test_search_equals_all_products(spark, block, chunk):
    rows = vectors(1, 400)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a large group of equal vectors
    rows += [(20, rows[20][1]), (40, [0.0] * 12), (2000, [0.5, -0.5]), (2020, []), (2040, None), (2060, [1.0, None] * 6)]
    rows += [(2080, [float("nan")] * 12), (2100, [float("inf")] + [0.0] * 11), (None, rows[3][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    assert found(frame, block=block, chunk=chunk) == brute(rows)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert found(spark.createDataFrame([], schema)) == []
    assert found(spark.createDataFrame([(20, [1.0, 2.0], 0)], schema)) == []
    rows = [(20, [1.0, 2.0]), (1, [0.25, -1.0]), (2, [-3.0, 0.5])]
    assert found(spark.createDataFrame([(i, v, 0) for i, v in rows], schema)) == brute(rows)


def test_the_search_stops_before_all_postings_are_read(monkeypatch):
    draw = np.random.default_rng(2)
    data = np.floor(64 * draw.normal(size=(4000, 32)) / 32**0.5).astype(int)
    index, query = topk.ImpactIndex(data), data[5]
    members = index.search(query, 10, 5)
    exact = data @ query
    exact[5] = exact.min() - 1
    assert set(np.argsort(-exact, kind="stable")[:10]) <= set(members)
    assert len(members) <= topk.MEMBERS * 10 < 4000


def test_bounds_hold_for_odd_weights():
    draw = random.Random(3)
    for _ in range(200):
        n, dims, k = draw.randint(1, 30), draw.randint(1, 5), draw.randint(1, 5)
        data = np.array([[draw.choice([0, 0, 1, -1, 5, -40, 300]) for _ in range(dims)] for _ in range(n)])
        query = np.array([draw.choice([0, 1, -3, 64]) for _ in range(dims)])
        own = draw.randint(-1, n - 1)
        at, scores = topk.ImpactIndex(data).best(query, k, np.arange(n), own)
        expected = sorted((-int(v @ query), i) for i, v in enumerate(data) if i != own)[:k]
        assert [(-int(s), int(i)) for i, s in zip(at, scores)] == expected


def test_sums_beyond_64_bits_are_exact():
    draw = random.Random(4)
    for _ in range(60):
        n, dims, k = draw.randint(2, 300), draw.randint(1, 5), draw.randint(1, 3)
        large = 1 << draw.choice([20, 31, 44, 58])
        data = np.array([[draw.randint(-3, 3) for _ in range(dims)] for _ in range(n)])
        data[0] *= large  # the query, whose own score would pass 64 bits
        at, scores = topk.ImpactIndex(data).best(data[0] // 2, k, np.arange(n), 0)
        query = [int(x) // 2 for x in data[0]]
        expected = sorted((-sum(a * int(b) for a, b in zip(query, v)), i) for i, v in enumerate(data) if i)[:k]
        assert [(-int(s), int(i)) for i, s in zip(at, scores)] == expected


def test_what_has_no_64_bit_integer_fails(spark):
    schema = "vec_id long, embedding array<double>"
    for rows, message in (
        ([(20, [1e300]), (1, [1.0])], "a component is too large"),
        ([(20, [1e15, 0.0]), (1, [1e15, 1.0])], "a score passes 64 bits"),
    ):
        with pytest.raises(Exception, match=message):
            found(spark.createDataFrame(rows, schema))


def test_the_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert found(frame) == brute([(r.vec_id, r.embedding) for r in frame.collect()])


def test_a_task_never_holds_the_copies_of_a_block(spark, monkeypatch):
    """One pack and one copy at a time, of bounded size, for any number of tiles; no `explode`, which holds all its copies."""
    plan = topk.search(spark.createDataFrame(vectors(5, 200), "vec_id long, embedding array<double>"), block=20, chunk=2)
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()

    class Partition:
        get = staticmethod(lambda: Partition)
        partitionId = staticmethod(lambda: 1)

    monkeypatch.setattr(topk, "TaskContext", Partition)
    matrix = np.random.default_rng(6).integers(-64, 65, (70, 4))
    batches = []
    for a in range(0, 70, 9):
        values = pa.ListArray.from_arrays(np.arange(0, 4 * len(matrix[a : a + 9]) + 1, 4, "i4"), matrix[a : a + 9].ravel())
        batches.append(pa.RecordBatch.from_arrays([np.arange(a, min(70, a + 9)), np.arange(a, min(70, a + 9)), values], ["row", "vec_id", "values"]))
    copies = list(topk._packed(16, 4, False, lambda at: range(at * 1000, at * 1000 + 50))(iter(batches)))
    assert len(copies) == 5 * 50 and {c.num_rows for c in copies} == {1}
    assert max(c.nbytes for c in copies) < 16 * (8 + 8 + 4) + 100
    for tile in (1000, 1049):
        packs = [topk._unpacked(4, *(c[x][0].as_py() for x in ("rows", "ids", "vectors"))) for c in copies if c["tile"][0].as_py() == tile]
        rows, ids, values = (np.concatenate(part) for part in zip(*packs))
        assert rows.tolist() == ids.tolist() == list(range(70)) and (values == matrix).all()


@pytest.mark.parametrize("tasks,ranges", [(3, 4), (100, 1), (7, 100)])
def test_any_dealing_of_tiles_gives_the_same(spark, monkeypatch, tasks, ranges):
    """Several tiles for a task, one range or one for each chunk, blocks and packs cut by their components, values of all widths."""
    for name, value in (("TASKS", tasks), ("RANGES", ranges), ("BLOCK_COMPONENTS", 12 * 40), ("PACK_COMPONENTS", 12 * 7)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(7, 300)
    rows[40] = (40, [x * 3e4 for x in rows[40][1]])
    rows[41] = (41, [x * 1e8 for x in rows[41][1]])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found(frame, chunk=2) == brute(rows)


def test_packs_take_the_smallest_integers_that_hold_them():
    for value, width in ((127, 1), (-128, 1), (128, 2), (-129, 2), (1 << 15, 4), (-(1 << 31), 4), (1 << 31, 8), (-(1 << 62), 8)):
        small = topk._smallest(np.array([[0, value]]))
        assert small.itemsize == width and small.tolist() == [[0, value]]
        assert topk._unpacked(2, bytes(8), bytes(8), small.tobytes())[2].tolist() == [[0, value]]
