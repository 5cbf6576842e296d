"""Records against the pages, the merged index against a sort, archives through another reader's eyes."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from framelake.llm import warc
from framelake.llm.scratch import new_path, stored

SCHEMA = "page_id long, url string, html string, file string"


def brute(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    out, seen = [], set()
    for page_id, payload in sorted(payloads, key=lambda r: (r[0] is None, r[0] or 0)):
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same = [i for i, p in payloads if p == payload and i is not None]
        revisit = len(payload) >= least and payload in seen
        seen.add(payload)
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", min(same, default=None) if revisit else None))
    return sorted(out, key=repr)


def rows_of(frame):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


EDGE = [
    (5, "http://www.Example.org/a?b#c", "<p>one</p>"),
    (3, "http://b.example.org", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (1, "", None),
    (2, "https://u@example.org:443/x y", ""),
    (7, "http://example.org/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (8, "http://example.org/long", "z" * 3_000_000),
    (3, "http://a.example.org", "<p>one</p>"),
    (3, "http://a.example.org", "<p>one</p>"),
    (4, "http://example.org/4", "<p>other</p>"),
    (None, "http://example.org/null", "<p>other</p>"),
]


@pytest.mark.parametrize("least", [0, 12])
def test_pages_come_back(spark, least):
    frame = spark.createDataFrame([(*row, "f") for row in EDGE], SCHEMA)
    assert rows_of(warc.archive(frame, least)) == brute(EDGE, least)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merged_index_is_the_sorted_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(warc, "RUN_ROWS", 220)
    draw = random.Random(4)
    # a third of the captures are of one URL
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://{draw.choice('abc')}.example/{draw.random():.2f}", f"p{i % 50}", "f") for i in range(1500)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    folder = new_path(spark, "warc")
    runs = stored(warc.write(frame, folder), "runs")
    by_run = {}
    for row in runs.orderBy("run", "place").collect():
        by_run.setdefault(row.run, []).append((row.url_key, row.timestamp))
    assert len(by_run) >= 7 and all(run == sorted(run) for run in by_run.values())
    merged = warc.merge(runs).orderBy("index_part", "index_place").collect()
    keys = [(r.url_key, r.timestamp) for r in merged]
    assert keys == sorted(keys) and len(keys) == 1500
    sizes = [sum(r.index_part == p for r in merged) for p in range(15)]
    assert max(sizes) < 400 and sum(size > 0 for size in sizes) > 8
    assert rows_of(warc.read(warc.merge(runs), folder)) == brute([r[:3] for r in rows])


def test_readers_are_spread_and_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(i, f"http://example.org/{i}", f"p{i}" * 50, "f") for i in range(120)]
    folder = new_path(spark, "warc")
    runs = stored(warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), folder), "runs")
    index = stored(warc.merge(runs), "index")
    found = warc.read(index, folder)
    assert rows_of(found) == brute([r[:3] for r in rows])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    tasks = found.select(F.spark_partition_id().alias("task")).distinct().count()
    assert index.select("file").distinct().count() > 10 and tasks > 5
    places = [(r.url_key, r.timestamp) for r in found.orderBy("index_part", "index_place").collect()]
    assert places == sorted(places)


def test_an_entry_without_its_record_is_an_error(spark):
    folder = new_path(spark, "warc")
    index = stored(warc.merge(stored(warc.write(spark.createDataFrame([(1, "u", "p", "f")], SCHEMA), folder), "runs")), "index")
    with pytest.raises(Exception, match="no record"):
        warc.read(index.withColumn("offset", F.col("offset") + 1), folder).collect()


def test_loser_tree():
    draw = random.Random(1)
    for _ in range(300):
        runs = [sorted((draw.randint(0, 9), draw.randint(0, 3)) for _ in range(draw.randint(0, 8))) for _ in range(draw.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_archives_are_plain_gzip_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    frame = spark.createDataFrame([(*row, "f") for row in EDGE[:6]], SCHEMA).coalesce(1)
    index = warc.write(frame, f"file://{tmp_path}/w").collect()
    assert len({r.file for r in index}) > 1
    for row in index:
        data = (tmp_path / "w" / row.file).read_bytes()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") >= 1
        assert data[row.offset : row.offset + 2] == b"\x1f\x8b"
    text = b"".join(gzip.decompress((tmp_path / "w" / n).read_bytes()) for n in sorted({r.file for r in index}))
    assert text.count(b"WARC-Type: revisit") == sum(r[3] == "revisit" for r in brute(EDGE[:6]))


def test_url_keys(spark):
    urls = {
        "http://www.Example.org/a?b#c": "org,example)/a?b",
        "https://u@example.org:443": "org,example)/",
        "http://example.org:8080/": "org,example):8080/",
        None: ")/",
    }
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.key for r in frame.select("url", warc.url_key(frame["url"]).alias("key")).collect()} == urls


def test_damage_is_found():
    content = warc.record(1, "u", 0, b"payload", None, 0)
    assert warc.parse(content)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parse(content.replace(b"payload\r\n", b"pavload\r\n"))


def test_the_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows_of(warc.archive(frame)) == brute([(r.page_id, r.url, r.html) for r in frame.collect()])
