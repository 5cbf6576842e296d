"""Patch similarities inside and between frames.

A similarity matrix stays one array per source patch. The product of two frames is
the only dense algebra: blocks of source patches meet the target frame in an equi
join and an Arrow function multiplies the two matrices. A target row holds the
patches of one frame, which is also the size of every output array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.integers import div
from ..functions.vectors import as_doubles, l2_normalize, softmax


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _block_product(source: pd.Series, target: pd.Series, dim: pd.Series) -> pd.Series:
    """Row-major product of each source block with its transposed target matrix."""
    return pd.Series(
        [
            (np.asarray(s).reshape(-1, d) @ np.asarray(t).reshape(-1, d).T).ravel()
            for s, t, d in zip(source, target, dim)
        ]
    )


def _stack(features: DataFrame, keys: Sequence[str], vector: str, name: str) -> DataFrame:
    """(keys, <name>_patches, <name>): the vectors of a group flattened in patch order."""
    rows = F.sort_array(F.collect_list(F.struct("patch", F.col(vector).alias("v"))))
    return features.groupBy(*keys).agg(rows.alias("__rows")).select(
        *keys,
        F.col("__rows.patch").alias(f"{name}_patches"),
        F.flatten("__rows.v").alias(name),
    )


def affinity(
    features: DataFrame,
    time_shift: int = 1,
    normalize: bool = True,
    vector: str = "feature",
    block: int = 128,
) -> DataFrame:
    """(video, frame, patch, affinity): products with every patch of frame + time_shift.

    `time_shift` 0 gives the similarity of a frame with itself. Frames without a
    shifted partner have no row. Array position i is the i-th patch of the target.
    """
    values = l2_normalize(vector) if normalize else as_doubles(vector)
    base = features.select("video", "frame", "patch", values.alias("v"))
    source = _stack(base.withColumn("block", div("patch", block)), ["video", "frame", "block"], "v", "source")
    target = _stack(base.withColumn("frame", F.col("frame") - time_shift), ["video", "frame"], "v", "target")
    n_target = F.size("target_patches")
    product = source.join(target, ["video", "frame"]).select(
        "video",
        "frame",
        "source_patches",
        n_target.alias("k"),
        _block_product("source", "target", (F.size("target") / n_target).cast("int")).alias("flat"),
    )
    return product.select(
        "video", "frame", "k", "flat", F.posexplode("source_patches").alias("i", "patch")
    ).select(
        "video", "frame", "patch", F.slice("flat", F.col("i") * F.col("k") + 1, F.col("k")).alias("affinity")
    )


def target_transform(
    values: Column,
    patch: Column,
    temperature: float = 1.0,
    threshold: float | None = None,
    mask_diagonal: bool = False,
    use_softmax: bool = False,
) -> Column:
    """Similarity row to training target.

    Padding is "no value" (null) ahead of a softmax, else -1 / temperature. Without a
    softmax a thresholded value is divided by the temperature once more, while the
    diagonal keeps the plain padding.
    """
    padding = F.lit(None).cast("double") if use_softmax else F.lit(-1.0 / temperature)
    out = values
    if threshold is not None:
        out = F.transform(out, lambda x: F.when(x < threshold, padding).otherwise(x))
    out = F.transform(out, lambda x: x / temperature)
    if mask_diagonal:
        out = F.transform(out, lambda x, i: F.when(i == patch, padding).otherwise(x))
    return softmax(out) if use_softmax else out


def time_similarity_target(features: DataFrame, time_shift: int = 1, normalize: bool = True, **options) -> DataFrame:
    """(video, frame, patch, affinity, target)."""
    return affinity(features, time_shift, normalize).withColumn(
        "target", target_transform(F.col("affinity"), F.col("patch"), **options)
    )


def frame_heatmaps(
    features: DataFrame, logits: DataFrame, time_shift: int = 1, remove_last: int | None = None, **options
) -> DataFrame:
    """(video, frame, patch, affinity, target, prediction, difference).

    `logits` has one array per (video, frame, patch). Frames stop min(remove_last,
    time_shift) short of the sequence as both limits apply.
    """
    target = time_similarity_target(features, time_shift, **options)
    if remove_last is not None and remove_last > time_shift:
        from .projections import drop_last_frames

        logits = drop_last_frames(logits, remove_last, ["video"])
    prediction = logits.select("video", "frame", "patch", softmax("logits").alias("prediction"))
    return target.join(prediction, ["video", "frame", "patch"]).withColumn(
        "difference", F.zip_with("prediction", "target", lambda p, t: p - t)
    )


def time_shift_pairs(frames: DataFrame, time_shift: int, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each row with the values of the row `time_shift` frames later."""
    later = frames.select(
        *keys,
        (F.col("frame") - time_shift).alias("frame"),
        *[F.col(v).alias(f"later_{v}") for v in values],
    )
    return frames.select(*keys, "frame", *values).join(later, [*keys, "frame"])


def similarity_options(config: Column) -> Column:
    """Options of the time-similarity loss in a JSON config, with defaults.

    The loss called `loss_timesim` wins; otherwise the first loss whose target
    transform is a FeatureTimeSimilarity.
    """
    losses = F.map_entries(
        F.from_json(F.get_json_object(config, "$.model.losses"), "map<string,string>")
    )
    named = F.filter(losses, lambda e: e["key"] == "loss_timesim")
    by_transform = F.filter(
        losses,
        lambda e: F.coalesce(
            F.get_json_object(e["value"], "$.target_transform.name").endswith("FeatureTimeSimilarity"),
            F.lit(False),
        ),
    )
    loss = F.coalesce(F.get(named, F.lit(0))["value"], F.get(by_transform, F.lit(0))["value"])

    def option(name: str, cast: str, default) -> Column:
        return F.coalesce(
            F.get_json_object(loss, f"$.target_transform.{name}").cast(cast), F.lit(default).cast(cast)
        ).alias(name)

    shift = F.coalesce(F.get_json_object(loss, "$.target_transform.time_shift").cast("int"), F.lit(1))
    return F.struct(
        shift.alias("time_shift"),
        option("normalize", "boolean", True),
        option("temperature", "double", 1.0),
        F.get_json_object(loss, "$.target_transform.threshold").cast("double").alias("threshold"),
        option("mask_diagonal", "boolean", False),
        option("softmax", "boolean", True),
        F.coalesce(F.get_json_object(loss, "$.remove_last_n_frames").cast("int"), shift).alias("remove_last_n_frames"),
    )


# Default limits of the fixed heat-map scale.
FIXED_PROBABILITY_MAX = 0.4
FIXED_DIFFERENCE_MAX = 0.25


def fixed_scale_options(interactive: Column) -> Column:
    """struct(probability_max, difference_abs_max) from a JSON config; both must be positive."""

    def limit(name: str, default: float) -> Column:
        value = F.coalesce(F.get_json_object(interactive, f"$.{name}").cast("double"), F.lit(default))
        return F.when(value > 0, value).otherwise(F.raise_error(F.lit(f"{name} must be positive")))

    return F.struct(
        limit("fixed_probability_max", FIXED_PROBABILITY_MAX).alias("probability_max"),
        limit("fixed_difference_max", FIXED_DIFFERENCE_MAX).alias("difference_abs_max"),
    )
