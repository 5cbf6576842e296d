"""Queries over frame pixels and scans over time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_uniform
from ..functions.integers import div
from ..operators import frames as ops
from ..operators import sampling, scans
from ..session import ensure_checkpoint_dir
from ..streaming.late_scan import run_available, scan_late
from . import views as v
from .registry import micros, query, r6, s6, smicros


def pixels(spark, sf):
    """Patches as pixels of several images: three components after another are an image's channels."""
    return v.patches(spark, sf).select(
        "video", "frame", *v.grid_yx(), F.posexplode(F.col("feature").cast("array<double>")).alias("at", "value")
    ).select(
        "video", "frame", F.floor(F.col("at") / 3).alias("image"), "y", "x", (F.col("at") % 3).alias("channel"), "value"
    )


PIXELS = {
    "pixels": """SELECT video, frame, c // 3 AS image, y, x, c % 3 AS channel, feature[c + 1] AS value
      FROM (SELECT *, unnest(range(len(feature))) AS c FROM patches)"""
}


@query(
    "pixel_normalize",
    v.with_views("patches", extra=PIXELS)
    + f"""SELECT video, frame, image, y, x, channel::INT AS channel, {s6('(u / 255.0::DOUBLE - m) / s')} AS normalized,
    {s6('u / 255.0::DOUBLE')} AS restored, CAST(u AS INT) AS as_uint8 FROM (
      SELECT *, floor((value + 1) * 127) AS u, [0.485, 0.456, 0.406][channel + 1]::DOUBLE AS m, [0.229, 0.224, 0.225][channel + 1]::DOUBLE AS s FROM pixels)""",
)
def pixel_normalize(spark, sf):
    """Byte pixels scaled, normalised, restored, and back to bytes."""
    raw = pixels(spark, sf).withColumn("byte", F.floor((F.col("value") + 1) * 127).cast("int"))
    scaled = ops.unit_scale(raw, "byte", ["video", "frame", "image"])
    normal = ops.normalize_pixels(F.col("byte"), F.col("channel"))
    restored = ops.denormalize_pixels(normal, F.col("channel"))
    # The restored value may miss an exact byte by one unit in the last place.
    return scaled.select(
        "video",
        "frame",
        "image",
        "y",
        "x",
        "channel",
        r6(normal).alias("normalized"),
        r6(restored).alias("restored"),
        ops.to_uint8(F.round(restored, 9) + 1e-9).alias("as_uint8"),
    )


@query(
    "center_crop",
    v.with_views("patches")
    + """SELECT video, frame, y - 1 AS y, x - 1 AS x, label FROM patches WHERE y - 1 BETWEEN 0 AND 1 AND x - 1 BETWEEN 0 AND 2""",
)
def center_crop(spark, sf):
    frame = v.patches(spark, sf).select("video", "frame", *v.grid_yx(), "label")
    return ops.center_crop(frame, (v.GRID_H, v.GRID_W), (2, 3))


@query(
    "center_full_crop",
    v.with_views("patches")
    + """SELECT video, frame, y, x, label FROM patches WHERE x BETWEEN 0 AND 3""",
)
def center_full_crop(spark, sf):
    """The largest centred square of a 4 x 5 frame; the offset 0.5 rounds to 0."""
    frame = v.patches(spark, sf).select("video", "frame", *v.grid_yx(), "label")
    return ops.center_full_crop(frame, (v.GRID_H, v.GRID_W))


@query("hflip", v.with_views("patches") + f"SELECT video, frame, y, {v.GRID_W} - 1 - x AS x, label FROM patches")
def hflip(spark, sf):
    return ops.hflip(v.patches(spark, sf).select("video", "frame", *v.grid_yx(), "label"), v.GRID_W)


OUT_H, OUT_W = 7, 3


@query(
    "resize_bilinear",
    v.with_views(
        "patches",
        extra={
            "gy": f"SELECT oy, greatest((oy + 0.5) * {v.GRID_H} / {OUT_H}::DOUBLE - 0.5, 0) AS sy FROM range({OUT_H}) r(oy)",
            "gx": f"SELECT ox, greatest((ox + 0.5) * {v.GRID_W} / {OUT_W}::DOUBLE - 0.5, 0) AS sx FROM range({OUT_W}) r(ox)",
            "taps": f"""SELECT oy, ox, floor(sy)::INT AS y0, least(floor(sy) + 1, {v.GRID_H - 1})::INT AS y1, sy - floor(sy) AS fy,
              floor(sx)::INT AS x0, least(floor(sx) + 1, {v.GRID_W - 1})::INT AS x1, sx - floor(sx) AS fx FROM gy, gx""",
            "img": "SELECT video, frame, c AS channel, y, x, feature[c + 1] AS value FROM (SELECT *, unnest(range(len(feature))) AS c FROM patches)",
        },
    )
    + f"""SELECT a.video, a.frame, a.channel::INT AS channel, oy AS y, ox AS x,
    {s6('(1-fy)*(1-fx)*a.value + (1-fy)*fx*b.value + fy*(1-fx)*c.value + fy*fx*d.value')} AS value
    FROM taps JOIN img a ON a.y = y0 AND a.x = x0 JOIN img b ON b.video = a.video AND b.frame = a.frame AND b.channel = a.channel AND b.y = y0 AND b.x = x1
    JOIN img c ON c.video = a.video AND c.frame = a.frame AND c.channel = a.channel AND c.y = y1 AND c.x = x0
    JOIN img d ON d.video = a.video AND d.frame = a.frame AND d.channel = a.channel AND d.y = y1 AND d.x = x1""",
)
def resize_bilinear(spark, sf):
    image = v.patches(spark, sf).select(
        "video", "frame", *v.grid_yx(), F.posexplode(F.col("feature").cast("array<double>")).alias("channel", "value")
    )
    out = ops.resize_bilinear(image, ["video", "frame", "channel"], (v.GRID_H, v.GRID_W), (OUT_H, OUT_W))
    return out.withColumn("value", r6(F.col("value")))


@query(
    "patchify",
    v.with_views("patches", extra={**PIXELS, "square": "SELECT * FROM pixels WHERE x < 4"})
    + f"""SELECT video, frame, image, (y // 2) * 2 + x // 2 AS patch, {smicros('list(value ORDER BY y, x, channel)')} AS "values"
    FROM square GROUP BY video, frame, image, (y // 2) * 2 + x // 2""",
)
def patchify(spark, sf):
    """2 x 2 patches of the centred square."""
    square = ops.center_full_crop(pixels(spark, sf), (v.GRID_H, v.GRID_W))
    out = ops.patchify(square, ["video", "frame", "image"], 2, 4)
    return out.withColumn("values", micros("values"))


# --- scans --------------------------------------------------------------------


def sequence(spark, sf):
    """Event values per user in time order; the event id numbers them."""
    return v.table(spark, sf, "events").select("user_id", "event_id", "value")


@query(
    "scan_over_time_sum",
    f"""SELECT user_id, event_id, {s6('s - value')} AS state, {s6('s')} AS state_next FROM (
      SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)""",
)
def scan_over_time_sum(spark, sf):
    out = scans.scan_sum(sequence(spark, sf), ["user_id"], "event_id", "value")
    return out.select(
        "user_id", "event_id", r6(F.col("state")).alias("state"), r6(F.col("state_next")).alias("state_next")
    )


DECAY = 0.9
STATE = T.StructType([T.StructField("state", T.DoubleType()), T.StructField("state_next", T.DoubleType())])


def decay_step(state, value, t):
    """Exponential memory; the first step starts from its input."""
    updated = value if t == 0 else DECAY * state + (1.0 - DECAY) * value
    return {"state": state, "state_next": updated}


DECAY_SQL = f"""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events),
    s AS (SELECT user_id, event_id, t, 0::DOUBLE AS state, value AS state_next FROM o WHERE t = 1
      UNION ALL SELECT o.user_id, o.event_id, o.t, s.state_next, {DECAY}::DOUBLE * s.state_next + (1.0::DOUBLE - {DECAY}::DOUBLE) * o.value
      FROM s JOIN o ON o.user_id = s.user_id AND o.t = s.t + 1)
    SELECT user_id, event_id, {s6('state')} AS state, {s6('state_next')} AS state_next FROM s"""


def rounded_states(out, shift=0.0):
    states = [r6(F.col(c) + F.lit(shift) if shift else F.col(c)).alias(c) for c in ("state", "state_next")]
    return out.select("user_id", "event_id", *states)


@query("scan_over_time_decay", DECAY_SQL)
def scan_over_time_decay(spark, sf):
    """A user step function carried along every sequence."""
    out = scans.scan_steps(sequence(spark, sf), ["user_id"], "event_id", "value", decay_step, 0.0, STATE)
    return rounded_states(out)


#: Composed steps round in another order than a loop does, so states are moved off the decimal halves before rounding.
OFF_HALVES = 1.2345678e-9


@query(
    "scan_over_time_affine",
    DECAY_SQL.replace(s6("state"), s6(f"state + {OFF_HALVES!r}::DOUBLE")).replace(
        s6("state_next"), s6(f"state_next + {OFF_HALVES!r}::DOUBLE")
    ),
)
def scan_over_time_affine(spark, sf):
    """The same memory as composed affine steps, without Python; the first step starts from its input."""
    value = F.col("value")
    decay, share, first = F.lit(DECAY), F.lit(1.0 - DECAY) * value, (F.lit(0.0), value)
    out = scans.scan_affine(sequence(spark, sf), ["user_id"], "event_id", decay, share, first=first)
    return rounded_states(out, OFF_HALVES)


#: Parts in which the events come to the stream; a fifth of them come one part late.
PARTS = 3
#: Steps that one bucket of users holds, on average.
STEPS = 1 << 13


@query("scan_stream_late", DECAY_SQL)
def scan_stream_late(spark, sf):
    """The same memory on a stream: events come as files in parts, some late, and the query is restarted for each part."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{folder}/in"
    events = v.table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    low, high, rows = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("*")).first()
    if low is None:
        return rounded_states(scans.scan_steps(events, ["user_id"], "event_id", "value", decay_step, 0.0, STATE))
    span = (high - low) // PARTS + 1
    late = (hash_uniform(23, "event_id") < 0.2).cast("long")
    parts = events.withColumn("part", div(F.unix_micros("ts") - low, span) + late)
    # A part holds nothing older than the start of the one before it, so a delay of three parts drops no step.
    delay = 3 * (span // 1_000_000 + 1)
    buckets = max(64, rows // STEPS)
    # the last one only moves the watermark past all others: nothing comes after it that could release it
    end = F.timestamp_micros(F.lit(high + (delay + 1) * 1_000_000))
    closing = events.agg(F.max("user_id").alias("user_id"), F.max("event_id").alias("event_id"), end.alias("ts"), F.lit(0.0).alias("value"))
    for part in [parts.filter(F.col("part") == i).drop("part") for i in range(PARTS + 1)] + [closing]:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        out = scan_late(stream, ["user_id"], "ts", "event_id", "value", decay_step, 0.0, STATE, f"{delay} seconds", buckets=buckets)
        run_available(out, f"{folder}/out", f"{folder}/checkpoint")
    return rounded_states(spark.read.parquet(f"{folder}/out"))


@query(
    "stack_steps",
    v.with_views(
        "mixed_frames",
        extra={
            "keyed": "SELECT *, dataset_index || '-' || episode_index || '_' || (frame_index // 2) AS chunk_key FROM mixed_frames WHERE frame_index // 2 < length // 2"
        },
    )
    + """SELECT chunk_key, string_agg(CAST(absolute_index AS VARCHAR), ',' ORDER BY frame_index) AS steps,
    string_agg(CAST(task_index AS VARCHAR), ',' ORDER BY frame_index) AS tasks FROM keyed GROUP BY chunk_key""",
)
def stack_steps(spark, sf):
    """Per-step values stacked per chunk of two frames."""
    frames = v.mixed_frames(spark, sf).withColumn("key", F.concat_ws("-", "dataset_index", "episode_index"))
    chunks = sampling.split_to_chunks(frames, 2)
    out = scans.stack_steps(chunks, ["chunk_key"], "frame_in_chunk", ["absolute_index", "task_index"])
    as_text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("chunk_key", as_text("absolute_index").alias("steps"), as_text("task_index").alias("tasks"))
