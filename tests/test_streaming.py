"""The streaming scan ends with the rows of the batch scan."""

import pytest
from pyspark.sql import functions as F

from framelake.operators import scans
from framelake.plans import views
from framelake.plans.frames import STATE, decay_step
from framelake.streaming.scan import scan_stream


def test_stream_equals_batch(spark, sf, tmp_path):
    events = views.table(spark, sf, "events").select("user_id", "event_id", "value")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Several files in event order, one per micro-batch, so state crosses batches.
    top = events.agg(F.max("event_id")).first()[0]
    for part in range(3):
        low, high = part * (top + 1) // 3, (part + 1) * (top + 1) // 3
        events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    scanned = scan_stream(stream, ["user_id"], "event_id", "value", decay_step, 0.0, STATE)
    query = (
        scanned.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batch = scans.scan_steps(events, ["user_id"], "event_id", "value", decay_step, 0.0, STATE)
    rounded = lambda df: sorted(
        (r["user_id"], r["event_id"], round(r["state"], 9), round(r["state_next"], 9)) for r in df.collect()
    )
    assert rounded(spark.read.parquet(out)) == rounded(batch)


def test_a_late_step_fails_the_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, 5, 1.0), (1, 6, 1.0)], "user_id long, event_id long, value double")
    for part in (rows, rows.withColumn("event_id", F.col("event_id") - 3)):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    scanned = scan_stream(stream, ["user_id"], "event_id", "value", decay_step, 0.0, STATE)
    query = (
        scanned.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    with pytest.raises(Exception, match="came after"):
        query.awaitTermination()
