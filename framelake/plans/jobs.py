"""End-to-end jobs: build a feature cache, score masks, measure agreement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import agreement, metrics, similarity
from ..operators.episodes import attach_dataset_info, cache_row_ids, clamped_context, episode_offsets, frame_offsets
from ..operators.splits import split_by_fraction
from ..operators.udfs import predict_features
from ..schemas import PROVENANCE
from ..session import materialize
from ..sources.cache_store import write_cache


def build_feature_cache(
    frames: DataFrame,
    episodes: DataFrame,
    info: DataFrame,
    predict: Callable,
    path: str,
    shape: tuple[int, int],
    num_frames: int = 4,
    splits: Sequence[str] = ("train", "val", "test"),
    val_fraction: float = 0.1,
    test_fraction: float = 0.1,
    seed: int = 0,
    inputs: Sequence[str] = (),
    **options,
) -> None:
    """Frames of many datasets -> clamped windows -> predictor -> checked cache.

    `frames` has dataset_index, episode_index, frame_index, timestamp and task_index
    plus the predictor's `inputs`; `episodes` has dataset_index, episode_index, length.
    """
    assigned = split_by_fraction(episodes, val_fraction, test_fraction, seed, ["dataset_index"])
    plan = materialize(episode_offsets(assigned, ["dataset_index"]))
    rows = cache_row_ids(frames, plan, splits).withColumn(
        "absolute_index", F.col("dataset_from_index") + F.col("frame_index")
    )
    windows = clamped_context(rows, frame_offsets(num_frames)).select(*PROVENANCE, *inputs)
    predicted = predict_features(windows, predict, T.ArrayType(T.ArrayType(T.FloatType())))
    expected = plan.filter(F.col("split").isin(list(splits))).agg(F.sum("length")).first()[0]
    if not expected:
        raise ValueError("no frames in the requested splits")
    write_cache(attach_dataset_info(predicted, info), path, shape, int(expected), **options)


def evaluate_masks(true: DataFrame, pred: DataFrame, **options) -> DataFrame:
    """One row of mean scores over videos: ARI and best-overlap IoU of pooled frames."""
    ari = metrics.adjusted_rand_index(true, pred, ["video"], ["frame", "y", "x"], **options)
    iou = metrics.mean_iou(true, pred, ["video"], ["frame", "y", "x"], "overlap", **options)
    scores = ari.select(F.lit("video_ari").alias("metric"), F.col("ari").alias("score")).unionByName(
        iou.select(F.lit("video_mbo").alias("metric"), F.col("mean_iou").alias("score"))
    )
    return metrics.merge_states(metrics.metric_state(scores, "score", ["metric"]), ["metric"])


def measure_agreement(features: DataFrame, logits: DataFrame, **options) -> DataFrame:
    """The per-video agreement report."""
    maps = similarity.frame_heatmaps(features, logits, **options)
    return agreement.video_report(agreement.row_statistics(maps))
