"""The given tables in the roles of the data model, in Spark and in SQL.

Each view exists twice: as a DataFrame and as a named SQL fragment that the
oracles put in their WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.integers import div
from ..functions.vectors import as_doubles
from ..operators.episodes import episode_offsets
from ..operators.label_frames import pack_labels
from ..operators.masks import soft_array_to_hard
from ..operators.mixing import mixed_union
from ..operators.numbering import dense_index
from ..operators.splits import split_by_fraction
from ..session import materialize
from ..sources.synthetic import square_images

SEED = 42
FPS_A, FPS_B = 10.0, 12.0
VAL, TEST = 0.25, 0.25
GRID_H, GRID_W = 4, 5
PATCHES, FRAMES = GRID_H * GRID_W, 5
SLOTS = 64
# Slots fold onto this many predicted classes.
CLASSES = 8

ROLE_CODES = {"user": 0, "assistant": 1, "system": 2}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- episodes and frames ------------------------------------------------------


def episodes_a(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("episode_index")).agg(
        F.count(F.lit(1)).alias("length")
    )


def role_code():
    code = F.lit(None).cast("long")
    for role, number in ROLE_CODES.items():
        code = F.when(F.col("role") == role, F.lit(number).cast("long")).otherwise(code)
    return code


def turns_a(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of the first dataset without their episode's bounds."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_index"),
        F.col("turn").alias("frame_index"),
        (F.col("turn") / FPS_A).alias("timestamp"),
        role_code().alias("task_index"),
    )


def bounded(frames: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    return frames.join(bounds, keys).withColumn(
        "absolute_index", F.col("dataset_from_index") + F.col("frame_index")
    )


def frames_a(spark: SparkSession, sf: str) -> DataFrame:
    return bounded(turns_a(spark, sf), episode_offsets(episodes_a(spark, sf)), ["episode_index"])


LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def episodes_b(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode_index")).agg(
        F.count(F.lit(1)).alias("length")
    )


def turns_b(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "episode_index")
    # The line number leads the order, so a very long order is numbered by several tasks.
    return dense_index(
        lines, LINE_ORDER, F.col("l_linenumber"), "frame_index", partition=["episode_index"]
    ).select(
        "episode_index",
        "frame_index",
        (F.col("frame_index") / FPS_B).alias("timestamp"),
        (F.col("l_linenumber") - 1).cast("long").alias("task_index"),
    )


def frames_b(spark: SparkSession, sf: str) -> DataFrame:
    return bounded(turns_b(spark, sf), episode_offsets(episodes_b(spark, sf)), ["episode_index"])


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Task texts; the system role has none, which exercises the default."""
    return (
        table(spark, sf, "conversations")
        .filter(F.col("role") != "system")
        .select(role_code().alias("task_index"), F.col("role").alias("task"))
        .distinct()
    )


def mixed_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes of both datasets; the keys are united first, so one shuffle counts them."""
    keys = mixed_union(
        [
            table(spark, sf, "conversations").select(F.col("conv_id").alias("episode_index")),
            table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode_index")),
        ]
    )
    return keys.groupBy("dataset_index", "episode_index").agg(F.count(F.lit(1)).alias("length"))


def stored_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """The episodes, counted once: numbering reads them several times."""
    return materialize(mixed_episodes(spark, sf))


def mixed_splits(spark: SparkSession, sf: str) -> DataFrame:
    return split_by_fraction(stored_episodes(spark, sf), VAL, TEST, SEED, ["dataset_index"])


def episode_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Length, split and frame range of every episode: the planning table of a cache run.

    It has one row per episode and several readers, so it is computed once.
    """
    return materialize(episode_offsets(mixed_splits(spark, sf), ["dataset_index"]))


def mixed_turns(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_union([turns_a(spark, sf), turns_b(spark, sf)])


def mixed_frames(spark: SparkSession, sf: str) -> DataFrame:
    bounds = episode_offsets(stored_episodes(spark, sf), ["dataset_index"])
    return bounded(mixed_turns(spark, sf), bounds, ["dataset_index", "episode_index"])


def dataset_info(spark: SparkSession, sf: str) -> DataFrame:
    """One row per dataset, described from what its table holds."""
    described = [
        table(spark, sf, name).agg(F.count(F.lit(1)).alias("n_source_rows")).select(
            F.lit(i).cast("long").alias("dataset_index"),
            F.lit(f"repo/{name}").alias("repo_id"),
            F.lit(f"/data/{name}").alias("root"),
            F.lit(camera).alias("camera_key"),
            F.lit(fps).alias("fps"),
        )
        for i, (name, camera, fps) in enumerate(
            (("conversations", "images.top", FPS_A), ("lineitem", "images.wrist", FPS_B))
        )
    ]
    return described[0].unionByName(described[1])


# --- patches and masks --------------------------------------------------------


def patches(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    per_video = PATCHES * FRAMES
    return table(spark, sf, "embeddings").select(
        div(v, per_video).alias("video"),
        div(F.pmod(v, F.lit(per_video)), PATCHES).alias("frame"),
        F.pmod(v, F.lit(PATCHES)).cast("long").alias("patch"),
        F.col("embedding").alias("feature"),
        F.col("label").cast("long").alias("label"),
    )


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select(
        "video", "frame", "patch", F.slice(as_doubles("feature"), 1, PATCHES).alias("logits")
    )


def grid_yx():
    return (
        div("patch", GRID_W).alias("y"),
        F.pmod("patch", F.lit(GRID_W)).cast("long").alias("x"),
    )


def true_mask(spark: SparkSession, sf: str) -> DataFrame:
    return patches(spark, sf).select("video", "frame", *grid_yx(), F.col("label").alias("class"))


def overlapping_mask(spark: SparkSession, sf: str) -> DataFrame:
    """The true mask, where points with a large first component belong to a second class too."""
    second = (
        patches(spark, sf)
        .filter(F.get("feature", F.lit(0)).cast("double") > 0.1)
        .select("video", "frame", *grid_yx(), F.pmod(F.col("label") + 1, F.lit(10)).alias("class"))
    )
    return true_mask(spark, sf).unionByName(second)


def soft_values():
    return F.transform(as_doubles("feature"), lambda v: (v + 1.0) / 2.0)


def pred_mask(spark: SparkSession, sf: str) -> DataFrame:
    """The class of the largest of all components."""
    return patches(spark, sf).select(
        "video", "frame", *grid_yx(), F.pmod(soft_array_to_hard(soft_values()), F.lit(CLASSES)).alias("class")
    )


def label_frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row a frame: packed labels of the true, the overlapping and the predicted mask, in one scan."""
    soft = F.pmod(soft_array_to_hard(soft_values()), F.lit(CLASSES))
    second = F.when(F.get("feature", F.lit(0)).cast("double") > 0.1, F.pmod(F.col("label") + 1, F.lit(10)))
    one = patches(spark, sf).select("video", "frame", *grid_yx(), "label", soft.alias("soft"), second.alias("second"))
    nothing = F.lit(None).cast("long")
    # a point's second class is an entry of its own, which the other two masks don't have
    first = F.struct(F.col("label").alias("true"), F.col("label").alias("overlapping"), F.col("soft").alias("pred"))
    more = F.struct(nothing.alias("true"), F.col("second").alias("overlapping"), nothing.alias("pred"))
    entries = F.when(F.col("second").isNull(), F.array(first)).otherwise(F.array(first, more))
    rows = one.select("video", "frame", "y", "x", F.explode(entries).alias("e"))
    sides = {name: F.col(f"e.{name}") for name in ("true", "overlapping", "pred")}
    return pack_labels(rows, ["video", "frame"], GRID_H, GRID_W, sides)


SIDE, OBJECTS = 24, 3


def square_masks(spark: SparkSession, sf: str, shift_x: int = 0) -> DataFrame:
    """One image of squares per supplier: video = nation, frame = supplier, class 0 = background."""
    images = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("video"), F.col("s_suppkey").alias("frame")
    )
    return square_images(images, "frame", SIDE, SIDE, OBJECTS, SEED, shift_x)


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("video_id"),
        F.col("event_type").alias("category_id"),
        F.col("value").alias("avg_area"),
        (F.get_json_object("props", "$.k").cast("long") >= 80).cast("long").alias("iscrowd"),
    )


# --- the same in SQL ----------------------------------------------------------


def uniform_sql(seed, key: str, word: int = 0) -> str:
    tag = f"{seed}/{word}" if word else seed
    return f"(('0x' || substr(md5('{tag}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "episodes_a": (
        (),
        """SELECT conv_id AS episode_index, count(*) AS length FROM conversations GROUP BY conv_id""",
    ),
    "bounds_a": (
        ("episodes_a",),
        """SELECT *, CAST(sum(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS dataset_from_index,
             CAST(sum(length) OVER (ORDER BY episode_index) AS BIGINT) AS dataset_to_index FROM episodes_a""",
    ),
    "frames_a": (
        ("bounds_a",),
        f"""SELECT c.conv_id AS episode_index, c.turn AS frame_index, c.turn / {FPS_A}::DOUBLE AS timestamp,
             CAST(CASE c.role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 END AS BIGINT) AS task_index,
             b.length, b.dataset_from_index, b.dataset_to_index, b.dataset_from_index + c.turn AS absolute_index
             FROM conversations c JOIN bounds_a b ON b.episode_index = c.conv_id""",
    ),
    "episodes_b": (
        (),
        """SELECT l_orderkey AS episode_index, count(*) AS length FROM lineitem GROUP BY l_orderkey""",
    ),
    "bounds_b": (
        ("episodes_b",),
        """SELECT *, CAST(sum(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS dataset_from_index,
             CAST(sum(length) OVER (ORDER BY episode_index) AS BIGINT) AS dataset_to_index FROM episodes_b""",
    ),
    "frames_b": (
        ("bounds_b",),
        f"""SELECT r.episode_index, r.frame_index, r.frame_index / {FPS_B}::DOUBLE AS timestamp,
             CAST(r.l_linenumber - 1 AS BIGINT) AS task_index,
             b.length, b.dataset_from_index, b.dataset_to_index, b.dataset_from_index + r.frame_index AS absolute_index
             FROM (SELECT l_orderkey AS episode_index, l_linenumber,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS frame_index
                   FROM lineitem) r JOIN bounds_b b USING (episode_index)""",
    ),
    "tasks": (
        (),
        """SELECT DISTINCT CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS BIGINT) AS task_index,
             role AS task FROM conversations WHERE role <> 'system'""",
    ),
    "mixed_episodes": (
        ("episodes_a", "episodes_b"),
        """SELECT 0::BIGINT AS dataset_index, episode_index, length FROM episodes_a
           UNION ALL SELECT 1::BIGINT, episode_index, length FROM episodes_b""",
    ),
    "mixed_splits": (
        ("mixed_episodes",),
        f"""SELECT dataset_index, episode_index, length,
             CASE WHEN k < greatest(1, round_even(n * {VAL}, 0)) THEN 'val'
                  WHEN k < greatest(1, round_even(n * {VAL}, 0)) + greatest(1, round_even(n * {TEST}, 0)) THEN 'test'
                  ELSE 'train' END AS split
             FROM (SELECT *, count(*) OVER (PARTITION BY dataset_index) AS n,
                     row_number() OVER (PARTITION BY dataset_index
                       ORDER BY md5('{SEED}:' || episode_index), episode_index) - 1 AS k FROM mixed_episodes)""",
    ),
    "mixed_frames": (
        ("frames_a", "frames_b"),
        """SELECT 0::BIGINT AS dataset_index, * FROM frames_a UNION ALL SELECT 1::BIGINT, * FROM frames_b""",
    ),
    "split_episodes": (
        ("mixed_splits",),
        """SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS split_index FROM mixed_splits""",
    ),
    "cache_rows": (
        ("mixed_frames", "split_episodes"),
        """SELECT f.*, e.split, e.split_index,
             row_number() OVER (ORDER BY e.split_index, f.dataset_index, f.episode_index, f.frame_index) - 1 AS row_id
             FROM mixed_frames f JOIN split_episodes e USING (dataset_index, episode_index)""",
    ),
    "patches": (
        (),
        f"""SELECT vec_id // {PATCHES * FRAMES} AS video, (vec_id % {PATCHES * FRAMES}) // {PATCHES} AS frame,
             vec_id % {PATCHES} AS patch, list_transform(embedding, lambda v: v::DOUBLE) AS feature,
             label::BIGINT AS label, (vec_id % {PATCHES}) // {GRID_W} AS y, (vec_id % {PATCHES}) % {GRID_W} AS x
             FROM embeddings""",
    ),
    "true_mask": (("patches",), """SELECT video, frame, y, x, label AS class FROM patches"""),
    "overlapping_mask": (
        ("patches",),
        """SELECT video, frame, y, x, label AS class FROM patches
           UNION ALL SELECT video, frame, y, x, (label + 1) % 10 FROM patches WHERE feature[1] > 0.1""",
    ),
    "pred_mask": (("hard_mask",), f"""SELECT video, frame, y, x, class % {CLASSES} AS class FROM hard_mask"""),
    "hard_mask": (
        ("patches",),
        """SELECT video, frame, y, x,
             CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS class
             FROM (SELECT *, list_transform(feature, lambda v: (v + 1.0) / 2.0) AS s FROM patches)""",
    ),
    "annotations": (
        (),
        """SELECT event_id AS id, user_id AS video_id, event_type AS category_id, value AS avg_area,
             CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 80 THEN 1 ELSE 0 END AS iscrowd
             FROM events""",
    ),
}


def _square_sql(shift_x: int, cls: str) -> str:
    limit = int(0.3 * SIDE)
    draws = ", ".join(
        f"CAST(floor({uniform_sql(f'{SEED}-{i}', 's_suppkey', word)} * {n}) AS BIGINT) AS {name}{i}"
        for i in range(OBJECTS)
        for word, (name, n) in enumerate((("x", SIDE), ("y", SIDE), ("s", limit)))
    )
    cases = " ".join(
        f"WHEN px - x{i} - {shift_x} BETWEEN 0 AND s{i} - 1 AND py - y{i} BETWEEN 0 AND s{i} - 1 THEN {i + 1}"
        for i in reversed(range(OBJECTS))
    )
    return f"""SELECT video, frame, y, x, CAST({cls} AS BIGINT) AS class FROM (
      SELECT video, frame, py AS y, px AS x, CASE {cases} ELSE 0 END AS label
      FROM (SELECT s_nationkey::BIGINT AS video, s_suppkey AS frame, {draws} FROM supplier),
        range({SIDE}) a(py), range({SIDE}) b(px))"""


SQL["square_true"] = ((), _square_sql(0, "label"))


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause that defines the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in SQL[name][0]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({SQL[name][1]})" for name in ordered]
    parts += [f"{name} AS ({body})" for name, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
