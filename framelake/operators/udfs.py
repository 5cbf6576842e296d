"""User functions: per column, and per batch of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PROVENANCE


def map_columns(df: DataFrame, transforms: dict[str, tuple[Callable[[pd.Series], pd.Series], T.DataType]]) -> DataFrame:
    """Replaces columns by vectorised user functions; the others pass through.

    Frames are rows, so the same call maps a function over time steps.
    """
    absent = [c for c in transforms if c not in df.columns]
    if absent:
        raise KeyError(f"columns not found: {absent}")
    return df.withColumns(
        {name: F.pandas_udf(_series(fn), dtype)(F.col(name)) for name, (fn, dtype) in transforms.items()}
    )


def _series(fn: Callable) -> Callable:
    def apply(values: pd.Series) -> pd.Series:
        return fn(values)

    return apply


def predict_features(
    windows: DataFrame,
    predict: Callable[[pd.DataFrame], Sequence],
    feature_type: T.DataType,
    provenance: Sequence[str] = PROVENANCE,
) -> DataFrame:
    """Provenance plus `features` for every frame window.

    `predict` sees a batch of rows and returns one feature per row; a batch of
    another size and missing provenance columns are errors.
    """
    absent = [c for c in provenance if c not in windows.columns]
    if absent:
        raise KeyError(f"missing provenance columns: {absent}")
    schema = T.StructType([*[windows.schema[c] for c in provenance], T.StructField("features", feature_type)])
    kept = list(provenance)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            features = list(predict(batch))
            if len(features) != len(batch):
                raise ValueError(f"predictor gave {len(features)} features for {len(batch)} rows")
            yield batch[kept].assign(features=features)

    return windows.mapInPandas(run, schema)


def equal_lengths(frames: DataFrame, key: str, others: Sequence[DataFrame]) -> DataFrame:
    """Sequences whose step counts differ between the inputs of a per-step function; expected empty."""
    counts = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n0"))
    for i, other in enumerate(others, 1):
        counts = counts.join(other.groupBy(key).agg(F.count(F.lit(1)).alias(f"n{i}")), key, "full")
    same = F.lit(True)
    for i in range(1, len(others) + 1):
        same = same & F.coalesce(F.col(f"n{i}") == F.col("n0"), F.lit(False))
    return counts.filter(~same)
