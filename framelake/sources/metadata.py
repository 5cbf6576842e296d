"""Dataset metadata: info.json, episode and task side files, layout, frame tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.episodes import episode_contiguity, episode_offsets
from ..schemas import DATASET_INFO, EPISODES, FRAMES, TASKS

# Accepted names of the two layouts.
LAYOUT_NAMES = {
    "auto": "auto", "2": "v2", "2.1": "v2", "v2": "v2", "v2.1": "v2",
    "3": "v3", "3.0": "v3", "v3": "v3", "v3.0": "v3",
}


def read_info(spark: SparkSession, *roots: str) -> DataFrame:
    """One row per dataset root, with `root` and the declared features as a map."""
    paths = [f"{root.rstrip('/')}/meta/info.json" for root in roots]
    info = spark.read.schema(DATASET_INFO).option("multiLine", True).json(paths)
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/meta/info\.json$", "")
    root = F.regexp_replace(folder, "^file:/+", "/")
    return info.select("*", root.alias("root"))


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.dropna(how="all")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException:
        return False


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    """Task table, empty when the file is missing."""
    path = f"{root}/meta/tasks.jsonl"
    return read_jsonl(spark, path, TASKS) if _exists(spark, path) else spark.createDataFrame([], TASKS)


def read_episodes(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """Episode table with frame offsets; in strict mode its ids must run 0..n-1 and match the info file."""
    episodes = read_jsonl(spark, f"{root}/meta/episodes.jsonl", EPISODES)
    if strict:
        declared = read_info(spark, root).select("total_episodes")
        report = episode_contiguity(episodes, declared).first()
        if not report["count_matches"] or report["n_gaps"] or report["n_duplicates"]:
            raise ValueError(f"episode table at {root} is not the declared run of ids: {report.asDict()}")
    return episode_offsets(episodes)


def layout_name(requested: str | None) -> str:
    name = LAYOUT_NAMES.get(str(requested or "auto").lower())
    if name is None:
        raise ValueError(f"unknown layout {requested}; use auto, v2 or v3")
    return name


def resolve_layout(spark: SparkSession, requested: str | None, root: str | None) -> str:
    """The requested layout, or the one that the files under `root` show."""
    name = layout_name(requested)
    if name != "auto":
        return name
    if root is None:
        return "v3"
    has_episode_file = _exists(spark, f"{root}/meta/episodes.jsonl")
    if not _exists(spark, f"{root}/meta/info.json"):
        return "v2" if has_episode_file else "v3"
    row = read_info(spark, root).select(layout_of(F.col("codebase_version"), F.lit(has_episode_file))).first()
    return row[0]


def layout_of(version: Column, has_episode_file: Column) -> Column:
    old = F.lower(F.coalesce(version, F.lit(""))).startswith("v2")
    return F.when(old | has_episode_file, "v2").otherwise("v3")


def episode_files(spark: SparkSession, root: str, episodes: Sequence[int]) -> list[str] | None:
    """Files of the episodes by the dataset's path template; None if its files don't hold one episode each."""
    if not _exists(spark, f"{root}/meta/info.json"):
        return None
    info = read_info(spark, root).select("data_path", "chunks_size").first()
    template = info["data_path"] or ""
    if "{episode_index" not in template:
        return None
    size = info["chunks_size"] or 1000
    names = (
        template.format(episode_chunk=e // size, chunk_index=e // size, episode_index=e, file_index=e, video_key="")
        for e in dict.fromkeys(map(int, episodes))
    )
    return [f"{root}/{name}" for name in names]


def read_frames(
    spark: SparkSession,
    root: str,
    episodes: Sequence[int] | DataFrame | None = None,
    schema=FRAMES,
) -> DataFrame:
    """Frame table of a dataset, only the selected episodes when given.

    A list names its files by the path template, so no other file is listed or opened; a
    file that isn't there is an error. Where a file holds many episodes the list is a
    pushed-down filter instead. A table becomes a semi join.
    """
    root = root.rstrip("/")
    listed = None if episodes is None or isinstance(episodes, DataFrame) else list(episodes)
    if listed is not None and not listed:
        return spark.createDataFrame([], schema)
    files = episode_files(spark, root, listed) if listed else None
    if files:
        return spark.read.schema(schema).parquet(*files)
    frames = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/data")
    if episodes is None:
        return frames
    if listed is None:
        return frames.join(episodes.select("episode_index"), "episode_index", "left_semi")
    return frames.filter(F.col("episode_index").isin([int(e) for e in listed]))
