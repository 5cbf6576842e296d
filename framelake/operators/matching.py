"""Optimal one-to-one matching of the class pairs of a sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-gain assignment of min(shape) pairs.

    Shortest augmenting paths with dual prices, vectorised over columns.
    """
    if gain.shape[0] > gain.shape[1]:
        return [(r, c) for c, r in best_assignment(gain.T)]
    cost = gain.max(initial=0.0) - gain
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        distance = np.full(m, np.inf)
        via = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, base, column = start, 0.0, -1
        while True:
            reduced = base + cost[row] - row_price[row] - col_price
            closer = ~done & (reduced < distance)
            distance[closer] = reduced[closer]
            via[closer] = column
            column = int(np.where(done, np.inf, distance).argmin())
            base = distance[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        settled = np.flatnonzero(done)
        for c in settled:
            if owner[c] >= 0:
                row_price[owner[c]] += base - distance[c]
            col_price[c] -= base - distance[c]
        row_price[start] += base
        while column >= 0:
            previous = int(via[column])
            owner[column] = owner[previous] if previous >= 0 else start
            column = previous
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)


def match_optimal(
    pairs: DataFrame, sample: Sequence[str], score: str, true: str = "true_class", pred: str = "pred_class"
) -> DataFrame:
    """The rows of `pairs` that a maximum-total matching by `score` selects in every sample.

    `pairs` is already aggregated to one row per class pair; pairs left out score
    zero. A group is the class-by-class score table of one sample, never its pixels.
    """
    schema = T.StructType([f for f in pairs.schema.fields])

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        rows, row_of = np.unique(table[true].to_numpy(), return_inverse=True)
        cols, col_of = np.unique(table[pred].to_numpy(), return_inverse=True)
        gain = np.zeros((len(rows), len(cols)))
        gain[row_of, col_of] = table[score].to_numpy(dtype=float)
        chosen = np.zeros(gain.shape, dtype=bool)
        for r, c in best_assignment(gain):
            chosen[r, c] = True
        return table[chosen[row_of, col_of]]

    return pairs.groupBy(*sample).applyInPandas(solve, schema)
