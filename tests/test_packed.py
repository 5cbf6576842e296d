"""Packed features, the bytes of a cache's shards, and the one-pass integrity report."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.packed import pack_matrix, unpack_matrix
from framelake.operators import cache_index


@pytest.mark.parametrize("dtype,item", [("float16", "<f2"), ("float32", "<f4")])
def test_matrices_keep_their_items(spark, dtype, item):
    draw = np.random.default_rng(1)
    rows = [(i, None if i % 7 == 3 else draw.normal(size=(3, 5)).tolist()) for i in range(40)] + [(99, [[7e4, -1e-9, 0.5, 1.0, -2.0]] * 3)]
    frame = spark.createDataFrame(rows, "i long, m array<array<float>>")
    packed = frame.select("i", pack_matrix(F.col("m"), dtype).alias("b"))
    back = packed.select("i", "b", unpack_matrix(F.col("b"), 3, 5, dtype).alias("m")).collect()
    assert len(back) == len(rows)
    with np.errstate(over="ignore"):
        for row, (i, matrix) in zip(sorted(back), sorted(rows, key=lambda r: r[0])):
            expected = None if matrix is None else np.array(matrix, "f4").astype(item)
            assert (row.b is None) == (matrix is None) == (row.m is None)
            if matrix is not None:
                assert row.b == expected.tobytes() and np.array_equal(np.array(row.m, "f4"), expected.astype("f4"))
    assert frame.limit(0).select(pack_matrix(F.col("m"), dtype)).count() == 0


def test_bytes_of_another_shape_fail(spark):
    frame = spark.createDataFrame([(bytes(10),)], "b binary")
    with pytest.raises(Exception, match="packed features differ"):
        frame.select(unpack_matrix(F.col("b"), 2, 2, "float32")).collect()


def report(rows, expected, shards, top):
    """The checks worked out row by row."""
    actual = {path: n for path, n, _ in shards}
    copies = Counter(i for i, *_ in rows)
    bad = {
        "row_out_of_bounds": [i for i in copies if not 0 <= i < expected],
        "duplicate_row": [i for i, n in copies.items() if n > 1],
        "missing_row": [i for i in range(expected) if i not in copies],
        "missing_shard": [i for i, path, *_ in rows if path not in actual],
        "shard_row_count": [i for i, path, _, n in rows if path in actual and n != actual[path]],
        "shard_offset": [i for i, path, at, _ in rows if at < 0 or path in actual and at >= actual[path]],
    }
    out = {name: (len(ids), ",".join(map(str, sorted(ids)[:top]))) for name, ids in bad.items()}
    return out | {"feature_shape": (max(0, len({shape for *_, shape in shards}) - 1), "")}


@pytest.mark.parametrize("bucket,merged", [(32_768, 1024), (16, 2)])
def test_report_equals_a_count_by_hand(spark, monkeypatch, bucket, merged):
    monkeypatch.setattr(cache_index, "BUCKET", bucket)
    monkeypatch.setattr(cache_index, "MERGED", merged)
    draw = random.Random(6)
    shards = [("a", 30, "4"), ("b", 5, "8"), ("c", 40, "4")]
    rows = [(draw.randint(-40, 260), draw.choice("abcd"), draw.randint(-2, 35), draw.choice([5, 30])) for _ in range(300)]
    rows += [(17, "b", 99, 1)] * 50  # a hot id
    index_schema = "row_id long, shard_path string, shard_offset long, shard_num_rows long"
    frame = spark.createDataFrame(shards, "shard_path string, actual_rows long, feature_shape string")
    for some in (rows, [], rows[:1]):
        index = spark.createDataFrame(some, index_schema)
        found = cache_index.integrity_report(spark, index, 220, frame, top=7).collect()
        assert {r.check: (r.n_bad, r.examples) for r in found} == report(some, 220, shards, 7)


def test_integrity_plan_is_lean(spark, sf):
    from framelake.plans.catalog import QUERIES

    plan = QUERIES["cache_index_integrity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and plan.count("Exchange ") <= 9
