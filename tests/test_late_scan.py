"""The scan on a stream whose steps come late: restarts, order, expiry, and steps behind the watermark."""

import datetime as dt

import pytest

from framelake.plans.frames import STATE, decay_step
from framelake.streaming.late_scan import run_available, scan_late

NOON = dt.datetime(2024, 5, 1, 12)
ROWS = "user_id long, at timestamp, n long, value double"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of each batch writes its state, so two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Feed:
    """A folder of files that is read one file a micro-batch."""

    def __init__(self, spark, folder, expiry=None, delay="10 seconds", **more):
        self.spark, self.expiry, self.delay, self.more = spark, expiry, delay, more
        self.source, self.out, self.checkpoint = (str(folder / name) for name in ("in", "out", "checkpoint"))

    def add(self, *rows):
        """Rows (user, second, value); the second is also the order."""
        full = [(user, None if at is None else NOON + dt.timedelta(seconds=at), at, value) for user, at, value in rows]
        self.spark.createDataFrame(full, ROWS).coalesce(1).write.mode("append").parquet(self.source)

    def run(self):
        stream = self.spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(self.source)
        scanned = scan_late(
            stream, ["user_id"], "at", "n", "value", decay_step, 0.0, STATE, self.delay, expiry_seconds=self.expiry, **self.more
        )
        run_available(scanned, self.out, self.checkpoint)
        return sorted((r.user_id, r.n, round(r.state, 9), round(r.state_next, 9)) for r in self.spark.read.parquet(self.out).collect())


def loop(rows, expiry=None):
    """The same by a plain loop over (user, second, value)."""
    found, carried = [], {}
    for user, at, value in sorted(rows, key=lambda r: r[:2]):
        state, t, last = carried.get(user, (0.0, 0, None))
        if last is not None and expiry is not None and at - last > expiry:
            state, t = 0.0, 0
        result = decay_step(state, value, t)
        carried[user] = (result["state_next"], t + 1, at)
        found.append((user, at, round(result["state"], 9), round(result["state_next"], 9)))
    return sorted(found)


END = (9, 10_000, 0.0)  # moves the watermark past every step before it


def test_late_steps_are_put_in_order_and_survive_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    rows = [(1, 3, 1.0), (2, 4, 5.0), (1, 8, 2.0)], [(1, 1, 7.0), (2, 2, 3.0)], [(1, 20, 4.0), (1, 12, 9.0), (2, 19, 6.0)]
    for part in rows[:2]:
        feed.add(*part)
        early = feed.run()
    assert early == []  # nothing is behind the watermark yet: all of it waits in the store
    feed.add(*rows[2])
    feed.add(END)
    assert feed.run() == loop([row for part in rows for row in part])


def test_a_step_behind_the_watermark_is_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    kept = [(1, 1, 1.0), (1, 100, 2.0)], [(1, 120, 4.0)]
    feed.add(*kept[0])
    feed.run()
    feed.add(*kept[1])
    feed.add((1, 50, 1000.0))
    feed.add(END)
    assert feed.run() == loop([row for part in kept for row in part])


def test_an_idle_sequence_starts_anew(spark, tmp_path):
    feed = Feed(spark, tmp_path, expiry=30)
    rows = [(1, 1, 1.0), (1, 31, 2.0), (2, 5, 3.0)], [(1, 100, 4.0), (2, 35, 8.0)], [(1, 130, 1.0), (2, 200, 5.0)]
    for part in rows:
        feed.add(*part)
        feed.run()
    feed.add(END)
    assert feed.run() == loop([row for part in rows for row in part], 30)


def test_what_an_idle_sequence_carries_is_removed(spark, tmp_path):
    feed = Feed(spark, tmp_path, expiry=30)
    feed.add(*[(user, user, 1.0) for user in range(50)])
    feed.run()
    feed.add((99, 1000, 1.0))
    feed.run()
    feed.add((99, 1001, 1.0))
    feed.run()
    stored = spark.read.format("statestore").option("stateVarName", "carried").load(feed.checkpoint)
    assert stored.count() == 0


def test_sequences_share_entries_of_the_state_store(spark, tmp_path):
    """Calls to the store are per bucket, not per sequence, whatever batches and late steps there are."""
    feed = Feed(spark, tmp_path, expiry=60, buckets=4)
    rows = [[(user, (user * 7 + k * 13) % 40 + 30 * part, float(user + k)) for user in range(150) for k in range(2)] for part in range(3)]
    for i, part in enumerate(rows):
        feed.add(*(step for step in part if step[0] % 2 or i))
        feed.run()
        for name in ("waiting", "carried", "timer"):
            stored = spark.read.format("statestore").option("stateVarName", name).load(feed.checkpoint)
            assert stored.select("key").distinct().count() <= 4
    assert 0 < len(feed.run()) < 850
    feed.add(END)
    late = [step for i, part in enumerate(rows) for step in part if step[0] % 2 or i]
    assert feed.run() == loop(late, 60)


def test_a_key_of_several_columns_that_clash_with_names(spark, tmp_path):
    kind = "n string, `a b` date, at timestamp, order int, value double"
    days = [dt.date(2024, 1, d) for d in (1, 2)]
    rows = [(f"x{k % 2}", days[k % 3 % 2], NOON + dt.timedelta(seconds=100 - k), 100 - k, float(k)) for k in range(40)]
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for part in (rows, [("end", days[0], NOON + dt.timedelta(days=1), 1, 0.0)]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        run_available(scan_late(stream, ["n", "a b"], "at", "order", "value", decay_step, 0.0, STATE, "200 seconds", buckets=2), out, checkpoint)
    found = sorted((r.n, r["a b"], r.order, round(r.state, 9), round(r.state_next, 9)) for r in spark.read.parquet(out).collect())
    plain = loop([((r[0], r[1]), r[3], r[4]) for r in rows])
    assert found == [(*key, *rest) for key, *rest in plain]


def test_nulls_repeats_and_an_empty_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add()
    assert feed.run() == []
    feed.add((None, 1, 1.0), (1, None, 1.0), (1, 2, 5.0), (1, 2, 5.0))
    feed.add(END)
    assert feed.run() == loop([(1, 2, 5.0), (1, 2, 5.0)])
