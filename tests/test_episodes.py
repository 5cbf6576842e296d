"""Golden values and invariants of episodes, splits, mixing and numbering."""

import pytest
from pyspark.sql import functions as F

from framelake.operators import episodes as ops
from framelake.operators import mixing, numbering, sampling, splits


def episodes(spark, lengths, dataset=None):
    rows = [(i, n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "episode_index long, length long")
    return df if dataset is None else df.withColumn("dataset_index", F.lit(dataset).cast("long"))


def frames(df):
    return sampling.explode_frames(df)


def test_offsets_and_clamped_context(spark):
    bounds = ops.episode_offsets(episodes(spark, [3, 2]))
    assert [(r[2], r[3]) for r in bounds.orderBy("episode_index").collect()] == [(0, 3), (3, 5)]
    rows = frames(bounds).withColumn("absolute_index", F.col("dataset_from_index") + F.col("frame_index"))
    got = ops.clamped_context(rows, ops.frame_offsets(2)).orderBy("absolute_index").collect()
    assert [r["context_frame_indices"] for r in got] == [[0, 0], [0, 1], [1, 2], [0, 0], [0, 1]]
    assert [r["context_is_pad"] for r in got][:2] == [[True, False], [False, False]]
    timed = ops.context_timestamps(ops.clamped_context(rows, ops.frame_offsets(2)), F.lit(10.0))
    assert timed.orderBy("absolute_index").first()["query_timestamps"] == [0.0, 0.0]


def test_offsets_window():
    assert ops.frame_offsets(4) == [-3, -2, -1, 0]
    assert ops.frame_offsets(3, include_current=False) == [-3, -2, -1]


@pytest.mark.parametrize("offsets", [[-1, 0], [-2, -1], [-1, 0, 2], [3]])
def test_gather_equals_brute_force(spark, offsets):
    lengths = [1, 2, 5]
    rows = frames(episodes(spark, lengths)).withColumn("v", F.col("episode_index") * 10 + F.col("frame_index"))
    got = {(r[0], r[1]): r["values"] for r in ops.gather_context(rows, "v", offsets).collect()}
    expected = {
        (e, f): [e * 10 + min(max(f + o, 0), n - 1) for o in offsets] for e, n in enumerate(lengths) for f in range(n)
    }
    assert got == expected


def test_full_context(spark):
    rows = ops.frames_full_context(frames(episodes(spark, [4])), [-1, 0, 1])
    assert sorted(r["frame_index"] for r in rows.collect()) == [1, 2]


def test_mixed_sizes_and_dense_rows(spark):
    both = episodes(spark, [3] * 4, 0).unionByName(episodes(spark, [3] * 4, 1))
    assigned = splits.split_by_fraction(both, 0.25, 0.25, 1, ["dataset_index"])
    full = ops.frames_full_context(frames(assigned), [-1, 0])
    assert {r["split"]: r["count"] for r in full.groupBy("split").count().collect()} == {"train": 8, "val": 4, "test": 4}
    rows = ops.cache_row_ids(frames(both), assigned).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(24))
    order = [(r["split_index"], r["dataset_index"], r["episode_index"], r["frame_index"]) for r in rows]
    assert order == sorted(order)
    with pytest.raises(ValueError):
        ops.cache_row_ids(frames(both), assigned, ["train", "dev"])


def test_split_rules(spark):
    ten = episodes(spark, [1] * 10)
    count = lambda df: {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    # 2.5 rounds half to even.
    assert count(splits.split_by_fraction(ten, 0.25, 0.0)) == {"val": 2, "train": 8}
    assert count(splits.split_by_fraction(ten, 0.0, 0.0)) == {"train": 10}
    assert count(splits.split_by_fraction(ten, 0.01, 0.01)) == {"val": 1, "test": 1, "train": 8}
    with pytest.raises(Exception, match="no training"):
        splits.split_by_fraction(episodes(spark, [1, 1]), 0.5, 0.4).collect()
    explicit = spark.createDataFrame([("val", 3), ("val", 4)], "split string, episode_index long")
    out = splits.split_explicit(ten, explicit, 0.5, 0.25).collect()
    assert {r["episode_index"] for r in out if r["split"] == "val"} == {3, 4}
    assert sum(r["split"] == "test" for r in out) == 2
    train = spark.createDataFrame([("train", 2)], "split string, episode_index long")
    assert [(r["episode_index"], r["split"]) for r in splits.split_explicit(ten, train).collect()] == [(2, "train")]


def test_list_checks(spark):
    listed = spark.createDataFrame(
        [("train", 1), ("train", 1), ("val", 1), ("val", 9), ("test", -1)], "split string, episode_index long"
    )
    problems = {tuple(r) for r in splits.episode_list_checks(listed, 5).collect()}
    assert problems == {("train", 1, "duplicate"), ("val", 9, "out_of_range"), ("test", -1, "out_of_range")}
    assert [tuple(r) for r in splits.split_overlap(listed).collect()] == [("train", "val", 1)]


def test_contiguity(spark):
    ok = ops.episode_contiguity(episodes(spark, [1, 1, 1]), 3).first()
    assert ok["count_matches"] and ok["n_gaps"] == 0 and ok["n_duplicates"] == 0
    broken = episodes(spark, [1, 1, 1, 1]).filter("episode_index <> 1")
    row = ops.episode_contiguity(broken.union(broken.filter("episode_index = 3")), 4).first()
    assert row["n_gaps"] == 1 and row["n_duplicates"] == 1


@pytest.mark.parametrize("width", [1, 3, 100])
def test_numbering_is_dense_for_hot_and_cold_keys(spark, width):
    rows = spark.range(60).selectExpr("case when id % 3 = 0 then 7 else id % 5 end as k", "id as o", "id % 4 as v")
    bucket = numbering.int_bucket("o", width)
    got = numbering.dense_index(rows, ["o"], bucket, "i", ["k"]).collect()
    sums = numbering.exclusive_prefix_sum(rows, "v", ["o"], bucket, "s", ["k"]).collect()
    for k in {r["k"] for r in got}:
        group = sorted((r for r in got if r["k"] == k), key=lambda r: r["o"])
        assert [r["i"] for r in group] == list(range(len(group)))
        total = 0
        for r in sorted((r for r in sums if r["k"] == k), key=lambda r: r["o"]):
            assert r["s"] == total
            total += r["v"]
    whole = numbering.dense_index(rows, ["o"], bucket, "i").collect()
    assert all(r["i"] == r["o"] for r in whole)


def test_weighted_sample_follows_weights(spark):
    rows = frames(episodes(spark, [40], 0).unionByName(episodes(spark, [10], 1))).withColumn("local_index", F.col("frame_index"))
    out = mixing.weighted_sample(spark, rows, 4000, (0.5, 0.5), seed=3)
    counts = {r["dataset_index"]: r["count"] for r in out.groupBy("dataset_index").count().collect()}
    assert sum(counts.values()) == 4000 and abs(counts[0] - 2000) < 200
    assert out.select("local_index").distinct().count() == 40
    with pytest.raises(Exception, match="empty dataset"):
        mixing.weighted_sample(spark, rows.filter("dataset_index = 0"), 100, (0.5, 0.5)).collect()
    with pytest.raises(ValueError):
        mixing.weighted_sample(spark, rows, 5)


def test_chunks_batches_shards(spark):
    videos = spark.createDataFrame([("a", 7), ("b", 2)], "key string, length long")
    chunks = sampling.split_to_chunks(frames(videos), 3)
    assert sorted({r["chunk_key"] for r in chunks.collect()}) == ["a_0", "a_1"]
    assert chunks.count() == 6
    assert sampling.one_chunk_per_video(chunks, "key", 3).count() == 3
    ids = spark.range(10).withColumnRenamed("id", "row_id")
    batches = sampling.assign_batches(ids, 4, F.lit(10), drop_last=True)
    assert sorted({r["batch"] for r in batches.collect()}) == [0, 1]
    repeated = sampling.epoch_repeat(ids, F.lit(10).cast("long"), F.lit(25).cast("long"))
    assert sorted((r["position"], r["row_id"]) for r in repeated.collect()) == [(p, p % 10) for p in range(25)]
    dealt = sampling.round_robin_shards(ids, 4).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    lengths = dealt.select("rank", "n", sampling.shard_length(F.lit(10), F.col("rank"), 4).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in lengths)
    row = ids.select(
        sampling.shard_length(F.lit(2), F.lit(3), 4).alias("none"),
        sampling.max_samples_per_worker(F.lit(17), F.lit(5), 1, 2).alias("bound"),
    ).first()
    assert (row["none"], row["bound"]) == (0, 12)


def test_padding_round_trip(spark):
    rows = spark.createDataFrame([(0, "a", 1.5), (0, "b", 2.5), (1, "c", 3.5)], "worker long, key string, v double")
    padded = sampling.pad_to_size(rows, 3)
    assert padded.count() == 6
    filler = padded.filter("batch_padding_mask").collect()
    assert {(r["key"], r["v"]) for r in filler} == {("PADDING", 0.0)}
    assert sorted(map(tuple, sampling.remove_padding(padded).collect())) == sorted(map(tuple, rows.collect()))
    check = sampling.exactly_once_check(padded, "key", 3).first()
    assert check["exactly_once"]
    assert not sampling.exactly_once_check(padded.union(padded), "key", 3).first()["exactly_once"]


def test_filler_arrays_have_the_shape_of_the_worker(spark):
    rows = spark.createDataFrame(
        [(0, "a", [[1.0, 2.0], [3.0, 4.0]]), (1, "b", [[5.0]]), (1, "c", None)], "worker long, key string, m array<array<double>>"
    )
    padded = sampling.pad_to_size(rows, 5000).filter("batch_padding_mask")
    found = {(r["worker"], r["key"], str(r["m"])): r["count"] for r in padded.groupBy("worker", "key", "m").count().collect()}
    assert found == {(0, "PADDING", "[[0.0, 0.0], [0.0, 0.0]]"): 4999, (1, "PADDING", "[[0.0]]"): 4998}


def test_an_empty_child_is_refused_even_if_no_draw_meets_it(spark):
    rows = frames(episodes(spark, [40], 0)).withColumn("local_index", F.col("frame_index"))
    with pytest.raises(Exception, match="empty dataset"):
        mixing.weighted_sample(spark, rows, 5, (1.0, 0.0), seed=3).collect()
