"""One key holds a third of all rows: results equal a brute-force count on the same data."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framelake.operators import annotations, episodes, lookup, metrics, numbering, sampling, scans


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows: episode 0 has 1,000 of them, the others 10 each."""
    rows = spark.range(3000).selectExpr(
        "case when id < 1000 then 0 else 1 + (id - 1000) div 10 end as episode_index",
        "case when id < 1000 then id else (id - 1000) % 10 end as frame_index",
        "(id * 7919) % 1009 as v",
        "case when id < 1000 then 1000L else 10L end as length",
    )
    return rows.repartition(8, F.rand(1))


@pytest.fixture(scope="module")
def plain(skewed):
    table = defaultdict(dict)
    for r in skewed.collect():
        table[r["episode_index"]][r["frame_index"]] = r["v"]
    return table


def test_numbering(skewed, plain):
    bucket = numbering.int_bucket("frame_index", 64)
    got = numbering.dense_index(skewed, ["frame_index"], bucket, "i", ["episode_index"])
    assert all(r["i"] == r["frame_index"] for r in got.collect()) and got.count() == 3000
    # No window group holds more than a bucket.
    assert skewed.groupBy("episode_index", bucket).count().agg(F.max("count")).first()[0] == 64


def test_every_hot_key_is_cut(spark):
    """1,500 keys of 40 rows each, in buckets of 16."""
    rows = spark.range(60_000).selectExpr("id % 1500 as k", "id div 1500 as o")
    bucket = numbering.int_bucket("o", 16)
    got = numbering.dense_index(rows, ["o"], bucket, "i", ["k"])
    assert got.filter("i <> o").count() == 0 and got.count() == 60_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(k" in plan and "__bucket" in plan.split("windowspecdefinition(k", 1)[1][:200]


def test_running_sum(skewed, plain):
    for df in (
        scans.scan_sum(skewed, ["episode_index"], "frame_index", "v", bucket_width=50),
        numbering.exclusive_prefix_sum(
            skewed, "v", ["frame_index"], numbering.int_bucket("frame_index", 50), "state", ["episode_index"]
        ),
    ):
        for r in df.collect():
            frames = plain[r["episode_index"]]
            if r["frame_index"] % 97 == 0:
                assert r["state"] == sum(frames[f] for f in range(r["frame_index"]))


def test_context_gather(skewed, plain):
    got = episodes.gather_context(skewed, "v", [-2, 0, 3])
    rows = got.collect()
    assert len(rows) == 3000
    for r in rows:
        frames = plain[r["episode_index"]]
        last = len(frames) - 1
        assert r["values"] == [frames[min(max(r["frame_index"] + o, 0), last)] for o in (-2, 0, 3)]


def test_chunks_and_one_chunk(skewed, plain):
    chunks = sampling.split_to_chunks(skewed, 4, key="episode_index")
    counts = Counter(r["episode_index"] for r in chunks.collect())
    assert counts == {e: len(f) // 4 * 4 for e, f in plain.items()}
    kept = Counter(r["episode_index"] for r in sampling.one_chunk_per_video(chunks, "episode_index", 4).collect())
    assert kept == {e: 4 for e in plain}


def test_lookup_of_a_hot_key(spark, skewed):
    index = skewed.select(F.col("episode_index").alias("k"), (F.col("v") + F.lit(0)).alias("row_id"))
    requests = spark.createDataFrame([(0,), (5,), (9999,)], "k long")
    status = {r["k"]: r["status"] for r in lookup.lookup_unique_key(requests, index, ["k"]).collect()}
    assert status == {0: "ambiguous", 5: "ambiguous", 9999: "missing"}


def test_scores_of_one_huge_sample(skewed, plain):
    true = skewed.select(F.col("episode_index").alias("s"), F.col("frame_index").alias("p"), F.pmod("v", F.lit(3)).alias("class"))
    pred = true.withColumn("class", F.when(F.pmod("p", F.lit(5)) == 0, 0).otherwise(F.col("class")).cast("long"))
    got = {r["s"]: r["mean_iou"] for r in metrics.mean_iou(true, pred, ["s"], ["p"]).collect()}
    for sample in (0, 7):
        t = {p: v % 3 for p, v in plain[sample].items()}
        q = {p: 0 if p % 5 == 0 else c for p, c in t.items()}
        def iou(a, b):
            left, right = {p for p in t if t[p] == a}, {p for p in q if q[p] == b}
            return len(left & right) / len(left | right)
        classes = set(t.values())
        best = [max(iou(a, b) for b in set(q.values())) for a in classes]
        assert got[sample] == pytest.approx(sum(best) / len(best))


def test_expansion_of_a_video_with_most_annotations(spark):
    videos = spark.createDataFrame([(0, 2), (1, 1), (2, 3)], "video_id long, length long")
    notes = spark.range(300).selectExpr("case when id < 200 then 0L else 1L end as video_id", "id", "id % 4 as category_id")
    segments = notes.selectExpr("id as annotation_id", "0L as frame_index", "1.5D as area")
    rows = annotations.expand_video_annotations(videos, notes, segments).collect()
    assert Counter(r["video_id"] for r in rows) == {0: 400, 1: 100, 2: 3}
    assert {r["instance"] for r in rows if r["video_id"] == 0} == set(range(200))
    assert all(r["is_empty"] == (r["frame_index"] > 0 or r["video_id"] == 2) for r in rows)


def test_gathering_tasks_hold_a_bounded_number_of_frames(spark, monkeypatch):
    """Narrow rows would be put into one task by their bytes; the number of frames sets the tasks."""
    monkeypatch.setattr(episodes, "GATHERED", 1000)
    frames = spark.range(20_000).select(
        (F.col("id") % 2).alias("episode_index"), F.expr("id div 2").alias("frame_index"), F.lit(10_000).cast("long").alias("length"), F.col("id").alias("v")
    )
    plain = episodes.gather_context(frames, "v", [-2, 0, 3])
    bounded = episodes.gather_context(frames, "v", [-2, 0, 3], rows=20_000)
    assert sorted(map(tuple, bounded.collect())) == sorted(map(tuple, plain.collect()))
    sizes = [r["count"] for r in bounded.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000
