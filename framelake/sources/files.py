"""Annotation files, frame folders, viewer manifests and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.agreement import REPORT_COLUMNS
from ..operators.annotations import pair_frames_with_masks
from ..schemas import ANNOTATION_FILE


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The videos, annotations and categories of an annotation file as three tables."""
    document = spark.read.schema(ANNOTATION_FILE).option("multiLine", True).json(path)

    def table(name: str) -> DataFrame:
        return document.select(F.explode(name).alias("row")).select("row.*")

    return {name: table(name) for name in ("videos", "annotations", "categories")}


def _list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, video, stem) of the files in `folder/<video>/`; the content is not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video"),
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"),
    )


def read_frame_folders(
    spark: SparkSession,
    frames: str,
    masks: str,
    splits: dict[str, str],
    frame_pattern: str = "*.jpg",
    mask_pattern: str = "*.png",
) -> DataFrame:
    """(video, stem, path, mask_path, split): every frame with its mask and its video's split.

    `splits` maps a split name to a file with one video per line. A video that no
    list names fails the job.
    """
    listed = None
    for name, path in splits.items():
        videos = spark.read.text(path).select(F.trim("value").alias("video"), F.lit(name).alias("split"))
        listed = videos if listed is None else listed.unionByName(videos)
    pairs = pair_frames_with_masks(
        _list_files(spark, frames, frame_pattern), _list_files(spark, masks, mask_pattern).select("path", "video", "stem")
    )
    found = pairs.join(listed.filter("video <> ''"), "video", "left")
    unknown = F.raise_error(F.concat(F.col("video"), F.lit(" is in no split list")))
    return found.withColumn("split", F.coalesce("split", unknown))


def read_manifests(spark: SparkSession, root: str, recursive: bool = False, limit: int | None = None) -> DataFrame:
    """Viewer manifests in `<root>/*-viewer/`, or anywhere below with `recursive`; adds manifest_path.

    `limit` keeps the first manifests by path.
    """
    path = root.rstrip("/")
    if not recursive:
        path = path if path.endswith("-viewer") else f"{path}/*-viewer"
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "manifest.json")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    manifests = reader.json(path).select("*", F.col("_metadata.file_path").alias("manifest_path"))
    return manifests if limit is None else manifests.orderBy("manifest_path").limit(limit)


def write_report(report: DataFrame, path: str, decimals: int = 8, overwrite: bool = False) -> None:
    """The per-video report as CSV with a header, fixed column order and fixed decimals."""
    types = dict(report.dtypes)
    columns = [
        F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if types[c] == "double" else F.col(c)
        for c in REPORT_COLUMNS
    ]
    report.select(*columns).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)
