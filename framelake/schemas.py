"""Declared schemas of the tables that the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

FRAMES = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("episode_index", T.LongType()),
        T.StructField("index", T.LongType()),
        T.StructField("task_index", T.LongType()),
    ]
)

EPISODES = T.StructType(
    [
        T.StructField("episode_index", T.LongType()),
        T.StructField("tasks", T.ArrayType(T.StringType())),
        T.StructField("length", T.LongType()),
    ]
)

TASKS = T.StructType(
    [T.StructField("task_index", T.LongType()), T.StructField("task", T.StringType())]
)

FEATURE = T.StructType(
    [
        T.StructField("dtype", T.StringType()),
        T.StructField("shape", T.ArrayType(T.LongType())),
        T.StructField("names", T.ArrayType(T.StringType())),
    ]
)

DATASET_INFO = T.StructType(
    [
        T.StructField("codebase_version", T.StringType()),
        T.StructField("robot_type", T.StringType()),
        T.StructField("total_episodes", T.LongType()),
        T.StructField("total_frames", T.LongType()),
        T.StructField("total_tasks", T.LongType()),
        T.StructField("total_videos", T.LongType()),
        T.StructField("total_chunks", T.LongType()),
        T.StructField("chunks_size", T.LongType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("splits", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data_path", T.StringType()),
        T.StructField("video_path", T.StringType()),
        T.StructField("features", T.MapType(T.StringType(), FEATURE)),
    ]
)

CACHE_INDEX = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("dataset_index", T.LongType()),
        T.StructField("repo_id", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("camera_key", T.StringType()),
        T.StructField("episode_index", T.LongType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("absolute_index", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("task_index", T.LongType()),
        T.StructField("context_absolute_indices", T.ArrayType(T.LongType())),
        T.StructField("context_frame_indices", T.ArrayType(T.LongType())),
        T.StructField("context_is_pad", T.ArrayType(T.BooleanType())),
        T.StructField("shard_path", T.StringType()),
        T.StructField("shard_offset", T.LongType()),
        T.StructField("shard_num_rows", T.LongType()),
    ]
)

# Columns that must travel with every batch through a user predictor.
PROVENANCE = (
    "row_id",
    "dataset_index",
    "split",
    "episode_index",
    "frame_index",
    "absolute_index",
    "timestamp",
    "task_index",
    "context_absolute_indices",
    "context_frame_indices",
    "context_is_pad",
)

SEGMENT = T.StructType(
    [
        T.StructField("size", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]
)

ANNOTATION_FILE = T.StructType(
    [
        T.StructField(
            "videos",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("width", T.LongType()),
                        T.StructField("height", T.LongType()),
                        T.StructField("length", T.LongType()),
                        T.StructField("file_names", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField(
            "annotations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("video_id", T.LongType()),
                        T.StructField("category_id", T.LongType()),
                        T.StructField("iscrowd", T.LongType()),
                        T.StructField("areas", T.ArrayType(T.DoubleType())),
                        T.StructField("avg_area", T.DoubleType()),
                        T.StructField("segmentations", T.ArrayType(SEGMENT)),
                    ]
                )
            ),
        ),
        T.StructField(
            "categories",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("supercategory", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

SAMPLES = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("members", T.MapType(T.StringType(), T.BinaryType())),
    ]
)
