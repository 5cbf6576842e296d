"""Scan over time on a stream whose steps may come late: buffered, released by the watermark, expired when idle."""

from __future__ import annotations

import json
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_TIME, _ORDER, _ITEM, _BUCKET = "__time", "__order", "__item", "__bucket"

#: Buckets of sequences that share an entry of the state store.
BUCKETS = 4096


class _LateScan(StatefulProcessor):
    """The sequences of one bucket: what they carry, and the steps the watermark hasn't passed, as blobs of a micro-batch.

    One timer is set at a time, at the first moment that a step is passed or a sequence expires.
    """

    def __init__(self, fold: Callable, keys: Sequence[T.StructField], order: T.StructField, expiry: int | None):
        self.fold, self.keys, self.order, self.expiry = fold, keys, order, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", T.StructType().add("sequences", T.BinaryType()))
        self.waiting = handle.getListState("waiting", T.StructType().add("steps", T.BinaryType()))
        self.timer = handle.getValueState("timer", T.StructType().add("millis", T.LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blobs, first = [], None
        for batch in rows:
            # by place: names may clash, and Spark renames what isn't an identifier
            times, orders, items = (batch.iloc[:, place].tolist() for place in (-3, -2, -1))
            sequences = zip(*(batch.iloc[:, place].tolist() for place in range(-4 - len(self.keys), -4)))
            steps = list(zip(sequences, times, orders, map(_plain, items)))
            if steps:
                blobs.append((pickle.dumps(steps),))
                first = min(times) if first is None else min(first, *times)
        if blobs:
            self.waiting.appendList(blobs)
            self._wake(_millis(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = defaultdict(list), []
        for (blob,) in self.waiting.get():
            for step in pickle.loads(blob):
                if step[1] <= passed:
                    ready[step[0]].append(step[1:])
                else:
                    rest.append(step)
        carried = pickle.loads(self.carried.get()[0]) if self.carried.exists() else {}
        sequences, orders, columns = [], [], defaultdict(list)
        for sequence, steps in ready.items():
            steps.sort(key=lambda s: s[:2])
            text, t, last = carried.get(sequence, ("null", 0, None))
            results, state, t, last = self.fold(steps, json.loads(text), t, last)
            carried[sequence] = (json.dumps(state), t, last)
            sequences += [sequence] * len(steps)
            orders += [step[1] for step in steps]
            for name, values in results.items():
                columns[name] += values
        kept = carried
        if self.expiry is not None:
            kept = {sequence: found for sequence, found in carried.items() if found[2] + self.expiry > passed}
        if ready:
            self.waiting.put([(pickle.dumps(rest),)]) if rest else self.waiting.clear()
        if kept and (ready or len(kept) < len(carried)):
            self.carried.update((pickle.dumps(kept),))
        elif carried and not kept:
            self.carried.clear()
        self.timer.clear()
        moments = [step[1] for step in rest]
        if self.expiry is not None:
            moments += [found[2] + self.expiry for found in kept.values()]
        if moments:
            self._wake(_millis(min(moments)))
        if ready:
            out = pd.DataFrame({self.order.name: orders})
            for place, (field, values) in enumerate(zip(self.keys, zip(*sequences))):
                out.insert(place, field.name, values)
            yield out.assign(**columns)

    def _wake(self, millis: int) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or millis < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(millis)
            self.timer.update((millis,))

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first watermark, in milliseconds, that has passed a time in microseconds."""
    return -(-micros // 1000)


def _plain(value):
    return value.tolist() if hasattr(value, "tolist") else value


def _folded(step: Callable, initial, names: Sequence[str], next_state: str, expiry: int | None) -> Callable:
    def fold(ready: list[tuple], state, t: int, last: int | None):
        results: dict[str, list] = {name: [] for name in names}
        for time, _, item in ready:
            if last is None or (expiry is not None and time - last > expiry):
                state, t = initial, 0
            result = step(state, item, t)
            for name in names:
                results[name].append(result[name])
            state, t, last = result[next_state], t + 1, time
        return results, state, t, last

    return fold


def scan_late(
    frames: DataFrame,
    keys: Sequence[str],
    time: str,
    order: str,
    inputs: str,
    step: Callable,
    initial,
    output: T.StructType,
    delay: str,
    expiry_seconds: int | None = None,
    next_state: str = "state_next",
    buckets: int = BUCKETS,
) -> DataFrame:
    """(keys, order, output) of a stream: `step(state, value, t) -> dict` taken by (time, order) in every sequence.

    Unlike `scan.scan_stream`, steps may come in any order within `delay` (a watermark on the timestamp column
    `time`): they wait in the state store, and a timer takes them once the watermark has passed them, so micro-batch borders never
    show in the results. Sequences are dealt into `buckets`, and a bucket is one entry of the state store, as each call to the store costs far
more than a step: a task holds the steps of the last `delay` of one bucket, and what its sequences carry, but never their past. More
sequences need more buckets; their number can't change once a checkpoint is there. Steps that
    come after the watermark has passed them are dropped, as by every stateful operator (`numRowsDroppedByWatermark`
    counts them).

    With `expiry_seconds` a step that comes more than that after the one before it starts anew from `initial`, and what a
    sequence carries is removed once the watermark is that far ahead; without it, it is kept for ever. Rows
    whose key, time or order is null are in no sequence and are left out; a null input is passed to `step`, repeated rows
    are steps of their own. Values of state are kept as JSON. Steps at the end of a stream wait until a later time is seen in any sequence.

    The query needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`, see `run_available`).
    """
    keys = list(keys)
    schema = T.StructType([*[frames.schema[c] for c in (*keys, order)], *output.fields])
    expiry = None if expiry_seconds is None else expiry_seconds * 1_000_000
    fold = _folded(step, initial, [f.name for f in output.fields], next_state, expiry)
    fields = [frames.schema[c] for c in keys]
    processor = _LateScan(fold, fields, frames.schema[order], expiry)
    rows = frames.dropna(subset=[*keys, time, order]).withWatermark(time, delay)
    # the timestamp stays beside its microseconds, as it carries the watermark
    micros = F.unix_micros(time).alias(_TIME)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias(_BUCKET)
    sent = rows.select(bucket, *keys, time, micros, F.col(order).alias(_ORDER), F.col(inputs).alias(_ITEM))
    return sent.groupBy(_BUCKET).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def run_available(scanned: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream into Parquet files at `path` until its source has no more, with the RocksDB state store."""
    conf = scanned.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        sink = scanned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        started = sink.trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
    started.awaitTermination()
