"""Scan over time on a stream: the state of every sequence lives in the state store."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scan_stream(
    frames: DataFrame,
    keys: Sequence[str],
    order: str,
    inputs: str,
    step: Callable,
    initial,
    output: T.StructType,
    next_state: str = "state_next",
) -> DataFrame:
    """The streaming twin of `scans.scan_steps`: same step function, same output rows.

    Steps of a sequence may arrive over any number of micro-batches as long as they
    arrive in order; inside a micro-batch they are sorted. The carried state and step
    number are kept as JSON, so any plain value can be a state. A step that is not
    after the last one of an earlier micro-batch fails the query.
    """
    carried = [frames.schema[c] for c in (*keys, order)]
    schema = T.StructType([*carried, *output.fields])
    stored = T.StructType([T.StructField("state", T.StringType()), T.StructField("t", T.LongType()), T.StructField("last", T.StringType())])
    names = [f.name for f in output.fields]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, t, last = initial, 0, None
        if state.exists:
            text, t, last = state.get
            value = json.loads(text)
        # Bounded by the micro-batch, which the source's trigger limits set.
        rows = pd.concat(list(batches)).sort_values(order)
        if last is not None and not rows[order].iloc[0] > rows[order].dtype.type(json.loads(last)):
            raise ValueError(f"{order} {rows[order].iloc[0]} of {key} came after {last}")
        results = {name: [] for name in names}
        for item in rows[inputs]:
            result = step(value, item, t)
            for name in names:
                results[name].append(result[name])
            value, t = result[next_state], t + 1
        state.update((json.dumps(value), t, json.dumps(rows[order].iloc[-1].item())))
        yield rows[[*keys, order]].assign(**results)

    return (
        frames.select(*keys, order, inputs)
        .groupBy(*keys)
        .applyInPandasWithState(run, schema, stored, "append", GroupStateTimeout.NoTimeout)
    )
