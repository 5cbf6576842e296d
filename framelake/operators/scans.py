"""State carried from frame to frame, and stacking of per-step results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.integers import div
from ..functions.vectors import let
from .numbering import exclusive_prefix_sum, int_bucket


def scan_sum(frames: DataFrame, keys: Sequence[str], order: str, value: str, bucket_width: int = 4096) -> DataFrame:
    """Adds state (before the step) and state_next of a running sum.

    A sum is associative, so long sequences are cut into buckets that several tasks
    fold, and only bucket totals are chained.
    """
    out = exclusive_prefix_sum(
        frames, value, [order], int_bucket(order, bucket_width), "state", partition=keys
    )
    return out.withColumn("state_next", F.col("state") + F.col(value))


def _after(x: Column, y: Column) -> Column:
    """The affine step x, then y."""
    return F.struct((y["a"] * x["a"]).alias("a"), (y["a"] * x["b"] + y["b"]).alias("b"))


def prefix_steps(steps: Column, width: int) -> Column:
    """For each of at most `width` affine steps (a, b) in an array, the composition of all up to it.

    In pass d each entry takes in what lies d places before it, so log2(width) passes over the array suffice.
    """

    def one_pass(d: int):
        return lambda s: F.transform(s, lambda x, i: F.when(i >= d, _after(F.get(s, i - d), x)).otherwise(x))

    d = 1
    while d < width:
        steps, d = let(steps, one_pass(d)), 2 * d
    return steps


def scan_affine(
    frames: DataFrame,
    keys: Sequence[str],
    order: str,
    factor: Column,
    shift: Column,
    initial: float = 0.0,
    first: tuple[Column, Column] | None = None,
    width: int = 64,
) -> DataFrame:
    """(keys, order, state, state_next) of the steps `state -> factor * state + shift`, taken by the integer `order`.

    Affine steps compose to an affine step, which is associative: (a, b), then (c, d), is (c * a, c * b + d). The
    steps of `width` values of `order` are a bucket, whose prefixes one task composes in an array; the composed buckets are
    steps again, `width` of them to a bucket of the next level, until a sequence is one. Then every level's
    buckets get the state they start from. So no task holds a sequence, and a key with a third of all rows is folded by
    as many tasks as it has buckets.

    `first` gives (factor, shift) of a sequence's first step, if that is another one. `order` is not negative and unique in
    a sequence; rows with a null key are no sequence and left out, as in `numbering`. A null factor or shift makes the state null from there
    on. Results differ from a plain loop by rounding only.
    """
    keys = list(keys)
    rows = frames.select(*keys, order, factor.cast("double").alias("a"), shift.cast("double").alias("b"))
    if first is not None:
        lead = frames.groupBy(*keys).agg(F.min(order).alias("__lead"))
        begun = [c.cast("double").alias(f"__first_{n}") for n, c in zip("ab", first)]
        rows = frames.select(*keys, order, factor.cast("double").alias("a"), shift.cast("double").alias("b"), *begun).join(lead, keys)
        leads = F.col(order) == F.col("__lead")
        rows = rows.select(*keys, order, *[F.when(leads, F.col(f"__first_{n}")).otherwise(F.col(n)).alias(n) for n in "ab"])
    last = frames.agg(F.max(order)).first()[0]
    rows = rows.withColumnRenamed(order, "__at")
    levels = []
    while True:
        bucket = rows.groupBy(*keys, div("__at", width).alias("__bucket"))
        packed = bucket.agg(F.sort_array(F.collect_list(F.struct("__at", "a", "b"))).alias("__steps"))
        bare = F.transform("__steps", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
        level = packed.select(*keys, "__bucket", F.col("__steps.__at").alias("__ats"), prefix_steps(bare, width).alias("__prefix"))
        levels.append(level)
        last = (last or 0) // width
        if not last:
            break
        total = F.element_at("__prefix", -1)
        rows = level.select(*keys, F.col("__bucket").alias("__at"), total["a"].alias("a"), total["b"].alias("b"))
    started = levels.pop().withColumn("__start", F.lit(float(initial)))
    while True:
        after = F.transform("__prefix", lambda x: x["a"] * F.col("__start") + x["b"])
        before = F.concat(F.array("__start"), F.slice(after, 1, F.size("__prefix") - 1))
        entries = F.explode(F.arrays_zip(F.col("__ats").alias("at"), before.alias("state"), after.alias("next")))
        states = started.select(*keys, entries.alias("e"))
        if not levels:
            return states.select(*keys, F.col("e.at").alias(order), F.col("e.state").alias("state"), F.col("e.next").alias("state_next"))
        starts = states.select(*keys, F.col("e.at").alias("__bucket"), F.col("e.state").alias("__start"))
        started = levels.pop().join(starts, [*keys, "__bucket"])


def scan_steps(
    frames: DataFrame,
    keys: Sequence[str],
    order: str,
    inputs: str,
    step: Callable,
    initial,
    output: T.StructType,
    next_state: str = "state_next",
) -> DataFrame:
    """Runs `step(state, value, t) -> dict` over every sequence in `order`.

    For steps that are not associative. Rows stream through a task sorted by
    (keys, order) and only the state is kept, so a sequence of any length fits.
    `output` names the fields of the dict; `next_state` is the one passed on.
    """
    carried = [frames.schema[c] for c in (*keys, order)]
    schema = T.StructType([*carried, *output.fields])
    names = [f.name for f in output.fields]
    key_names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, t = None, None, 0
        for batch in batches:
            results = {name: [] for name in names}
            for *key, value in batch[[*key_names, inputs]].itertuples(index=False, name=None):
                if key != current:
                    current, state, t = key, initial, 0
                result = step(state, value, t)
                for name in names:
                    results[name].append(result[name])
                state, t = result[next_state], t + 1
            yield batch[[*key_names, order]].assign(**results)

    rows = frames.select(*keys, order, inputs)
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def stack_steps(frames: DataFrame, keys: Sequence[str], step: str, values: Sequence[str]) -> DataFrame:
    """(keys, one array per value) in step order; keys include the chunk, which bounds a group."""
    rows = F.sort_array(F.collect_list(F.struct(step, *values)))
    return frames.groupBy(*keys).agg(rows.alias("__rows")).select(
        *keys, *[F.col(f"__rows.{v}").alias(v) for v in values]
    )
