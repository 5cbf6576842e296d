"""Queries over episode and frame tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.integers import div
from ..functions.paths import episode_path
from ..operators import episodes as ops
from ..operators import mixing, splits
from ..operators.numbering import int_bucket
from ..session import materialize
from . import views as v
from .registry import joined, micros, query, r6, s6, smicros

OFFSETS = ops.frame_offsets(4)
LIST = ", ".join(str(o) for o in OFFSETS)


@query(
    "scan_frames",
    v.with_views("mixed_splits")
    + """SELECT c.conv_id AS episode_index, c.turn AS frame_index, c.role AS role
    FROM conversations c JOIN mixed_splits s ON s.dataset_index = 0 AND s.episode_index = c.conv_id
    WHERE s.split <> 'train'""",
)
def scan_frames(spark, sf):
    """Only the frames of the selected (held-out) episodes."""
    held_out = v.mixed_splits(spark, sf).filter("dataset_index = 0 AND split <> 'train'")
    frames = v.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_index"), F.col("turn").alias("frame_index"), "role"
    )
    return frames.join(held_out.select("episode_index"), "episode_index", "left_semi")


@query(
    "episode_offsets",
    v.with_views("bounds_b")
    + "SELECT episode_index, length, dataset_from_index, dataset_to_index FROM bounds_b",
)
def episode_offsets(spark, sf):
    return ops.episode_offsets(v.episodes_b(spark, sf))


CONTEXT_SQL = v.with_views(
    "mixed_frames",
    extra={
        "context": f"""SELECT *, list_transform([{LIST}], lambda o:
      greatest(dataset_from_index, least(dataset_to_index - 1, absolute_index + o))) AS ctx,
      list_transform([{LIST}], lambda o: CASE WHEN absolute_index + o < dataset_from_index
      OR absolute_index + o >= dataset_to_index THEN 1 ELSE 0 END) AS pads FROM mixed_frames"""
    },
)


@query(
    "clamped_context",
    CONTEXT_SQL
    + """SELECT dataset_index, episode_index, frame_index, absolute_index,
    array_to_string(ctx, ',') AS context_absolute_indices,
    array_to_string(list_transform(ctx, lambda i: i - dataset_from_index), ',') AS context_frame_indices,
    array_to_string(pads, ',') AS context_is_pad FROM context""",
)
def clamped_context(spark, sf):
    frames = ops.clamped_context(v.mixed_frames(spark, sf), OFFSETS)
    return frames.select(
        "dataset_index",
        "episode_index",
        "frame_index",
        "absolute_index",
        joined("context_absolute_indices").alias("context_absolute_indices"),
        joined("context_frame_indices").alias("context_frame_indices"),
        joined(F.col("context_is_pad").cast("array<int>")).alias("context_is_pad"),
    )


@query(
    "context_timestamps",
    CONTEXT_SQL
    + f"""SELECT dataset_index, episode_index, frame_index,
    {smicros("list_transform(ctx, lambda i: (i - dataset_from_index) / (CASE dataset_index WHEN 0 THEN 10 ELSE 12 END)::DOUBLE)")}
    AS query_timestamps FROM context""",
)
def context_timestamps(spark, sf):
    frames = ops.clamped_context(v.mixed_frames(spark, sf), OFFSETS)
    fps = v.dataset_info(spark, sf).select("dataset_index", "fps")
    timed = ops.context_timestamps(frames.join(fps, "dataset_index"), F.col("fps"))
    return timed.select(
        "dataset_index", "episode_index", "frame_index", micros("query_timestamps").alias("query_timestamps")
    )


@query(
    "delta_timestamps",
    v.with_views("mixed_episodes")
    + f"""SELECT dataset_index, count(*) AS n_episodes,
    {smicros(f"list_transform([{LIST}], lambda o: o / (CASE dataset_index WHEN 0 THEN 10 ELSE 12 END)::DOUBLE)")} AS with_current,
    {smicros("list_transform([-4, -3, -2, -1], lambda o: o / (CASE dataset_index WHEN 0 THEN 10 ELSE 12 END)::DOUBLE)")} AS without_current
    FROM mixed_episodes GROUP BY dataset_index""",
)
def delta_timestamps(spark, sf):
    counts = v.mixed_episodes(spark, sf).groupBy("dataset_index").agg(F.count(F.lit(1)).alias("n_episodes"))
    info = v.dataset_info(spark, sf).join(counts, "dataset_index")
    return info.select(
        "dataset_index",
        "n_episodes",
        micros(ops.delta_timestamps(OFFSETS, F.col("fps"))).alias("with_current"),
        micros(ops.delta_timestamps(ops.frame_offsets(4, False), F.col("fps"))).alias("without_current"),
    )


@query(
    "frames_full_context",
    v.with_views("mixed_frames")
    + "SELECT dataset_index, episode_index, frame_index FROM mixed_frames WHERE frame_index >= 2 AND frame_index + 1 < length",
)
def frames_full_context(spark, sf):
    """Two frames back and one ahead."""
    frames = ops.frames_full_context(v.mixed_frames(spark, sf), [-2, 0, 1])
    return frames.select("dataset_index", "episode_index", "frame_index")


@query(
    "gather_context_values",
    v.with_views(
        "mixed_frames",
        extra={
            "slots": f"""SELECT f.dataset_index, f.episode_index, f.frame_index, o.j,
              greatest(f.dataset_from_index, least(f.dataset_to_index - 1, f.absolute_index + o.o)) AS abs_i
              FROM mixed_frames f, (SELECT unnest([{LIST}]) AS o, unnest([{", ".join(str(j) for j in range(len(OFFSETS)))}]) AS j) o"""
        },
    )
    + """SELECT s.dataset_index, s.episode_index, s.frame_index,
    string_agg(CAST(g.task_index AS VARCHAR), ',' ORDER BY s.j) AS task_values
    FROM slots s JOIN mixed_frames g ON g.dataset_index = s.dataset_index AND g.absolute_index = s.abs_i
    GROUP BY ALL""",
)
def gather_context_values(spark, sf):
    rows = sum(v.table(spark, sf, name).count() for name in ("conversations", "lineitem"))
    gathered = ops.gather_context(
        v.mixed_frames(spark, sf), "task_index", OFFSETS, ["dataset_index", "episode_index"], rows
    )
    return gathered.select("dataset_index", "episode_index", "frame_index", joined("values").alias("task_values"))


@query(
    "join_task_text",
    v.with_views("frames_a", "tasks")
    + """SELECT episode_index, frame_index, coalesce(t.task, '') AS task
    FROM frames_a f LEFT JOIN tasks t USING (task_index)""",
)
def join_task_text(spark, sf):
    frames = ops.attach_tasks(v.frames_a(spark, sf), v.tasks(spark, sf))
    return frames.select("episode_index", "frame_index", "task")


@query(
    "join_dataset_info",
    v.with_views("cache_rows")
    + """SELECT row_id, split, CASE dataset_index WHEN 0 THEN 'repo/conversations' ELSE 'repo/lineitem' END AS repo_id,
    CASE dataset_index WHEN 0 THEN '/data/conversations' ELSE '/data/lineitem' END AS root,
    CASE dataset_index WHEN 0 THEN 'images.top' ELSE 'images.wrist' END AS camera_key FROM cache_rows""",
)
def join_dataset_info(spark, sf):
    rows = ops.cache_row_ids(v.mixed_turns(spark, sf), v.episode_plan(spark, sf))
    return ops.attach_dataset_info(rows, v.dataset_info(spark, sf)).select(
        "row_id", "split", "repo_id", "root", "camera_key"
    )


@query(
    "cache_row_ids",
    v.with_views("cache_rows")
    + "SELECT row_id, split_index, dataset_index, episode_index, frame_index FROM cache_rows",
)
def cache_row_ids(spark, sf):
    rows = ops.cache_row_ids(v.mixed_turns(spark, sf), v.episode_plan(spark, sf))
    return rows.select(
        "row_id", F.col("split_index").cast("int").alias("split_index"), "dataset_index", "episode_index", "frame_index"
    )


@query(
    "relative_index",
    v.with_views("frames_b", "mixed_splits")
    + """SELECT f.episode_index, f.frame_index, f.absolute_index, coalesce(r.relative_index, -1) AS relative_index
    FROM frames_b f LEFT JOIN (
      SELECT episode_index, frame_index,
        row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS relative_index
      FROM frames_b WHERE episode_index IN (SELECT episode_index FROM mixed_splits WHERE dataset_index = 1 AND split = 'train')
    ) r USING (episode_index, frame_index)""",
)
def relative_index(spark, sf):
    """Positions when only the training episodes are loaded."""
    selected = v.mixed_splits(spark, sf).filter("dataset_index = 1 AND split = 'train'")
    frames = ops.relative_index(v.frames_b(spark, sf), v.episodes_b(spark, sf), selected, missing=-1)
    return frames.select("episode_index", "frame_index", "absolute_index", "relative_index")


@query(
    "episode_contiguity",
    """SELECT 'lineitem' AS source, count(*) AS n_rows, (SELECT count(*) FROM orders) AS declared,
      count(*) = (SELECT count(*) FROM orders) AS count_matches, max(e) + 1 - count(DISTINCT e) AS n_gaps,
      count(*) - count(DISTINCT e) AS n_duplicates FROM (SELECT DISTINCT l_orderkey AS e FROM lineitem)
    UNION ALL
    SELECT 'conversations', count(*), (SELECT count(DISTINCT conv_id) FROM conversations),
      count(*) = (SELECT count(DISTINCT conv_id) FROM conversations), max(e) + 1 - count(DISTINCT e),
      count(*) - count(DISTINCT e) FROM (SELECT DISTINCT conv_id AS e FROM conversations)""",
)
def episode_contiguity(spark, sf):
    """Orders declare the episodes of lineitem; some have no line."""
    declared = v.table(spark, sf, "orders").agg(F.count(F.lit(1)))
    b = ops.episode_contiguity(v.episodes_b(spark, sf), declared)
    n_a = v.table(spark, sf, "conversations").agg(F.count_distinct("conv_id"))
    a = ops.episode_contiguity(v.episodes_a(spark, sf), n_a)
    return b.withColumn("source", F.lit("lineitem")).unionByName(a.withColumn("source", F.lit("conversations")))


@query(
    "episode_paths",
    v.with_views("episodes_b")
    + """SELECT episode_index,
    printf('data/chunk-%03d/episode_%06d.parquet', episode_index // 1000, episode_index) AS data_path,
    printf('videos/chunk-%03d/images.wrist/episode_%06d.mp4', episode_index // 1000, episode_index) AS video_path
    FROM episodes_b""",
)
def episode_paths(spark, sf):
    e = F.col("episode_index")
    return v.episodes_b(spark, sf).select(
        e,
        episode_path("data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", e).alias("data_path"),
        episode_path(
            "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4", e, video_key="images.wrist"
        ).alias("video_path"),
    )


# --- splits -------------------------------------------------------------------


@query(
    "split_by_fraction",
    v.with_views("mixed_splits") + "SELECT dataset_index, episode_index, split FROM mixed_splits",
)
def split_by_fraction(spark, sf):
    return v.mixed_splits(spark, sf).select("dataset_index", "episode_index", "split")


# The explicit validation list of dataset B: its longest episodes.
LONG = "length >= 8"


@query(
    "split_explicit",
    v.with_views(
        "episodes_b",
        extra={
            "free": f"SELECT * FROM episodes_b WHERE NOT ({LONG})",
            "ranked": """SELECT episode_index, count(*) OVER () AS n,
               row_number() OVER (ORDER BY md5('7:' || episode_index), episode_index) - 1 AS k FROM free""",
        },
    )
    + f"""SELECT episode_index, CASE WHEN k < greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split
    FROM ranked UNION ALL SELECT episode_index, 'val' FROM episodes_b WHERE {LONG}""",
)
def split_explicit(spark, sf):
    episodes = v.episodes_b(spark, sf)
    explicit = episodes.filter(LONG).select(F.lit("val").alias("split"), "episode_index")
    return splits.split_explicit(episodes, explicit, 0.3, 0.2, seed=7).select("episode_index", "split")


# Orders by status and by priority overlap, unlike a proper split.
LISTS = """SELECT DISTINCT o_orderstatus AS split, o_custkey AS episode_index FROM orders"""


@query(
    "split_overlap",
    f"""WITH lists AS ({LISTS})
    SELECT a.split AS left_split, b.split AS right_split, a.episode_index
    FROM lists a JOIN lists b ON a.episode_index = b.episode_index AND a.split < b.split""",
)
def split_overlap(spark, sf):
    """Customers as episodes, listed under the status of each of their orders."""
    assigned = v.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("split"), F.col("o_custkey").alias("episode_index")
    )
    return splits.split_overlap(assigned)


@query(
    "episodes_except_reserved",
    "SELECT o_orderkey AS episode_index FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
)
def episodes_except_reserved(spark, sf):
    declared = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode_index"))
    return splits.episodes_except(declared, v.episodes_b(spark, sf))


@query(
    "episodes_union",
    "SELECT o_orderkey AS episode_index FROM orders UNION SELECT l_orderkey FROM lineitem",
)
def episodes_union(spark, sf):
    declared = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode_index"))
    present = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode_index"))
    return splits.episodes_union(declared.union(present))


@query(
    "episode_list_checks",
    """WITH lists AS (SELECT l_returnflag AS split, l_partkey AS episode_index FROM lineitem),
    counted AS (SELECT split, episode_index, count(*) AS copies FROM lists GROUP BY ALL),
    bound AS (SELECT count(*) // 2 AS n FROM part)
    SELECT split, episode_index, 'duplicate' AS problem FROM counted WHERE copies > 1
    UNION ALL SELECT split, episode_index, 'out_of_range' FROM counted, bound WHERE episode_index < 0 OR episode_index >= n""",
)
def episode_list_checks(spark, sf):
    """Part lists per return flag against half the number of parts."""
    lists = v.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("split"), F.col("l_partkey").alias("episode_index")
    )
    total = v.table(spark, sf, "part").agg(div(F.count(F.lit(1)), 2)).scalar()
    return splits.episode_list_checks(lists, total)


@query(
    "tail_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= 300 THEN 'val' ELSE 'train' END AS split
    FROM documents""",
)
def tail_split(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id")
    return splits.tail_split(docs, "doc_id", 300, int_bucket("doc_id"))


@query(
    "split_sizes",
    v.with_views("cache_rows")
    + "SELECT dataset_index, split, count(*) AS n_samples FROM cache_rows GROUP BY ALL",
)
def split_sizes(spark, sf):
    """Frames per dataset and split, from episode lengths alone."""
    return (
        v.mixed_splits(spark, sf)
        .groupBy("dataset_index", "split")
        .agg(F.sum("length").alias("n_samples"))
    )


# --- mixing -------------------------------------------------------------------


@query(
    "mixed_union",
    v.with_views("mixed_frames")
    + "SELECT dataset_index, episode_index, frame_index, absolute_index, task_index FROM mixed_frames",
)
def mixed_union(spark, sf):
    return v.mixed_frames(spark, sf).select(
        "dataset_index", "episode_index", "frame_index", "absolute_index", "task_index"
    )


@query(
    "mixed_overrides",
    f"""SELECT n_nationkey::BIGINT AS dataset_index, n_name AS repo_id,
    coalesce(CASE WHEN n_regionkey = 0 THEN 0.1::DOUBLE END, 0.25::DOUBLE) AS val_fraction,
    coalesce(CASE WHEN n_regionkey <= 1 THEN n_nationkey::BIGINT END, 42::BIGINT) AS seed,
    'natural' AS sampling_mode FROM nation""",
)
def mixed_overrides(spark, sf):
    """Nations as datasets; some regions set their own fraction or seed."""
    children = v.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("dataset_index"),
        F.col("n_name").alias("repo_id"),
        F.when(F.col("n_regionkey") == 0, F.lit(0.1)).alias("val_fraction"),
        F.when(F.col("n_regionkey") <= 1, F.col("n_nationkey").cast("long")).alias("seed"),
    )
    out = mixing.mixed_overrides(children, {"val_fraction": 0.25, "seed": 42, "sampling_mode": "natural"})
    return out.withColumn("seed", F.col("seed").cast("long"))


WEIGHTS = (0.75, 0.25)


@query(
    "weighted_sample",
    v.with_views(
        "mixed_frames",
        extra={
            "local": """SELECT *, absolute_index AS local_index FROM mixed_frames""",
            "sizes": "SELECT dataset_index, count(*) AS size FROM mixed_frames GROUP BY 1",
            "draws": f"""SELECT event_id AS draw, CASE WHEN {v.uniform_sql(11, 'event_id')} >= 0.75 THEN 1 ELSE 0 END::BIGINT AS dataset_index,
              {v.uniform_sql(11, 'event_id', 1)} AS u2 FROM events""",
        },
    )
    + """SELECT d.draw, d.dataset_index, l.episode_index, l.frame_index
    FROM draws d JOIN sizes s USING (dataset_index)
    JOIN local l ON l.dataset_index = d.dataset_index AND l.local_index = CAST(floor(d.u2 * s.size) AS BIGINT)""",
)
def weighted_sample(spark, sf):
    """One draw per event, located among the episodes' frame ranges."""
    bounds = ops.episode_offsets(v.stored_episodes(spark, sf), ["dataset_index"])
    draws = v.table(spark, sf, "events").select(F.col("event_id").alias("draw"))
    out = mixing.weighted_frames(spark, materialize(bounds), weights=WEIGHTS, seed=11, draws=draws)
    return out.select("draw", "dataset_index", "episode_index", "frame_index")


@query(
    "shuffle_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    row_number() OVER (ORDER BY md5('3:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey),
      l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem""",
)
def shuffle_rows(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return splits.hash_order(lines, 3, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query(
    "random_hflip",
    v.with_views("patches")
    + f"""SELECT video, frame, patch, y, CASE WHEN {v.uniform_sql(5, 'video')} < 0.5 THEN {v.GRID_W} - 1 - x ELSE x END AS x,
    {smicros('feature')} AS value FROM patches""",
)
def random_hflip(spark, sf):
    """One coin per video: all its frames flip or none."""
    from ..operators.frames import hflip
    from ..operators.sampling import random_flip_flag

    pixels = v.patches(spark, sf).select(
        "video", "frame", "patch", *v.grid_yx(), micros(F.col("feature").cast("array<double>")).alias("value")
    )
    return hflip(pixels, v.GRID_W, random_flip_flag(5, 0.5, "video"))
