"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; learned filters of `2 * STEP` bytes slide over them by `STEP`
bytes. Activations are max-pooled over chunks of two blocks of `BLOCK` bytes; chunks overlap by one
block and cover the whole text, whose end is padded with zero bytes. The mean and the maximum of
the chunks' vectors are combined into one probability by a logistic layer.

Long texts stream through in segments with a running sum and maximum, so memory doesn't depend on
the length of a text. The text is the only input of a score.

Null texts count as empty; an empty text is one block of padding and gets a score as any other. Repeated
rows each give a row. Without a single usable label every score is the prior given to `fit`.

Training takes a bounded sample: the `SAMPLE` labelled documents with the lowest hash of their id,
and of each of them at most `TRAIN_BLOCKS` blocks, evenly spaced runs of `RUN` blocks. One task trains on it
(about 30 MB at most), and scoring carries the weights (about 25 kB) to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 4
BLOCK = 128
FILTERS = 32
DIMS = 8
#: Blocks that are convolved at once.
SEGMENT = 512

SAMPLE = 4000
TRAIN_BLOCKS = 64
RUN = 8
#: Steps of BATCH documents, however many there are.
STEPS = 700
BATCH = 32
RATE = 4e-3
THRESHOLD = 0.3
#: A document is held out if the crc32 of its id as text leaves this remainder by FOLDS.
FOLDS, HELD_OUT = 5, 0

_PER_BLOCK = BLOCK // STEP
_SHAPES = {
    "embedding": (256, DIMS),
    "filters": (STEP * DIMS, 2 * FILTERS),  # of the first and of the second half of a window
    "bias": (FILTERS,),
    "mean_weights": (FILTERS,),
    "max_weights": (FILTERS,),
    "offset": (1,),
}


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def initial(cls, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        scale = {"embedding": 0.5, "filters": (STEP * DIMS * 2) ** -0.5 * 2, "mean_weights": 0.1, "max_weights": 0.1}
        weights = {k: (draw.normal(size=s) * scale.get(k, 0)).astype("f4") for k, s in _SHAPES.items()}
        return cls(weights)

    def pack(self) -> bytes:
        return b"".join(self.weights[k].astype("<f4").tobytes() for k in _SHAPES)

    @classmethod
    def unpack(cls, data: bytes) -> Network:
        flat, weights, at = np.frombuffer(data, "<f4"), {}, 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            weights[name] = flat[at : at + size].reshape(shape).copy()
            at += size
        return cls(weights)

    def activations(self, tail: np.ndarray) -> np.ndarray:
        """Filter responses before the rectifier; tail: bytes of whole blocks and STEP bytes more."""
        w = self.weights
        groups = w["embedding"].take(tail, axis=0).reshape(-1, STEP * DIMS)
        halves = groups @ w["filters"]
        return halves[:-1, :FILTERS] + halves[1:, FILTERS:]

    def block_maxima(self, padded: np.ndarray) -> Iterator[np.ndarray]:
        """(blocks, filters) of each segment; padded: see `padded_bytes`."""
        for low in range(0, len(padded) - STEP, SEGMENT * BLOCK):
            part = padded[low : low + SEGMENT * BLOCK + STEP]
            maxima = self.activations(part).reshape(-1, _PER_BLOCK, FILTERS).max(axis=1)
            yield np.maximum(maxima + self.weights["bias"], 0)

    def score(self, text: str) -> float:
        total, most, chunks, last = np.zeros(FILTERS), np.zeros(FILTERS, "f4"), 0, None
        for blocks in self.block_maxima(padded_bytes(text.encode("utf-8", "replace"))):
            joined = blocks if last is None else np.concatenate([last, blocks])
            pooled = np.maximum(joined[:-1], joined[1:])
            total += pooled.sum(axis=0)
            chunks += len(pooled)
            most = np.maximum(most, blocks.max(axis=0))
            last = blocks[-1:]
        if not chunks:  # a text of one block is one chunk
            total, chunks = last[0].astype(float), 1
        w = self.weights
        logit = total / chunks @ w["mean_weights"] + most @ w["max_weights"] + w["offset"][0]
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def padded_bytes(data: bytes) -> np.ndarray:
    """Zero bytes up to whole blocks, at least one, and the STEP bytes that the last window looks ahead."""
    size = max(1, -(-len(data) // BLOCK)) * BLOCK + STEP
    padded = np.zeros(size, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return padded


def training_runs(text: str) -> list[bytes]:
    """Evenly spaced runs of RUN blocks, with the bytes that the last window looks ahead."""
    data = padded_bytes(text.encode("utf-8", "replace"))
    blocks = (len(data) - STEP) // BLOCK
    runs = -(-blocks // RUN)
    chosen = range(runs) if blocks <= TRAIN_BLOCKS else (i * runs // (TRAIN_BLOCKS // RUN) for i in range(TRAIN_BLOCKS // RUN))
    return [data[i * RUN * BLOCK : (i + 1) * RUN * BLOCK + STEP].tobytes() for i in chosen]


def _gradients(net: Network, texts: list[list[np.ndarray]], labels: np.ndarray) -> dict[str, np.ndarray]:
    w = net.weights
    grads = {k: np.zeros(s, "f4") for k, s in _SHAPES.items()}
    for runs, label in zip(texts, labels):
        kept, pooled, chunk_of = [], [], []
        for run in runs:
            groups = w["embedding"].take(run, axis=0).reshape(-1, STEP * DIMS)
            halves = groups @ w["filters"]
            out = (halves[:-1, :FILTERS] + halves[1:, FILTERS:]).reshape(-1, _PER_BLOCK, FILTERS)
            where = out.argmax(axis=1)
            top = np.take_along_axis(out, where[:, None], 1)[:, 0] + w["bias"]
            blocks = np.maximum(top, 0)
            later = blocks[1:] > blocks[:-1] if len(blocks) > 1 else np.zeros((1, FILTERS), bool)
            first = np.arange(len(later))[:, None]
            source = np.where(later, first + 1, first)  # block that gives a chunk its maximum
            kept.append((run, groups, where, top > 0))
            pooled.append(np.take_along_axis(blocks, source, 0))
            chunk_of.append(source)
        counts = [len(p) for p in pooled]
        chunks = np.concatenate(pooled)
        most = chunks.argmax(axis=0)
        mean, top = chunks.mean(axis=0), chunks[most, np.arange(FILTERS)]
        logit = mean @ w["mean_weights"] + top @ w["max_weights"] + w["offset"][0]
        error = np.float32(1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
        grads["mean_weights"] += error * mean
        grads["max_weights"] += error * top
        grads["offset"] += error
        into = np.broadcast_to(error * w["mean_weights"] / len(chunks), chunks.shape).copy()
        into[most, np.arange(FILTERS)] += error * w["max_weights"]
        at = 0
        for (run, groups, where, active), source, count in zip(kept, chunk_of, counts):
            delta = np.zeros(where.shape, "f4")
            np.add.at(delta, (source, np.arange(FILTERS)), into[at : at + count])
            at += count
            delta *= active
            grads["bias"] += delta.sum(axis=0)
            position = (np.arange(len(where))[:, None] * _PER_BLOCK + where).ravel()
            filters = np.tile(np.arange(FILTERS), len(where))
            flat = np.zeros((len(groups), 2 * FILTERS), "f4")
            flat[position, filters] = delta.ravel()
            flat[position + 1, filters + FILTERS] = delta.ravel()
            grads["filters"] += groups.T @ flat
            back = (flat @ w["filters"].T).reshape(-1, DIMS)
            for d in range(DIMS):
                grads["embedding"][:, d] += np.bincount(run, back[:, d], 256).astype("f4")
    return {k: g / len(labels) for k, g in grads.items()}


def train(runs: list[list[bytes]], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on the logistic loss; runs: see `training_runs`."""
    net, draw = Network.initial(seed), np.random.default_rng(seed)
    texts = [[np.frombuffer(r, np.uint8) for r in text] for text in runs]
    share = np.clip(labels.mean(), 0.01, 0.99)
    net.weights["offset"][:] = np.log(share / (1 - share))
    first = {k: np.zeros(s, "f4") for k, s in _SHAPES.items()}
    second = {k: np.zeros(s, "f4") for k, s in _SHAPES.items()}
    order = draw.permutation(len(texts))
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, draw.permutation(len(texts))])
        batch, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - step / (steps + 1))
        for k, g in _gradients(net, [texts[i] for i in batch], labels[batch]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [training_runs(text.as_py() or "") for text in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.binary()))], ["position", "quality", "runs"]
        )


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
    if rows:
        rows.sort(key=lambda row: (row[0], row[1], row[2]))
        net = train([runs for *_, runs in rows], np.array([quality for _, quality, _ in rows], "f4"))
        yield pa.RecordBatch.from_pydict({"weights": [net.pack()]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Network trained on at most `sample` documents that are labelled and not held out."""
    position = F.xxhash64("doc_id")
    usable = labels.select("doc_id", "quality").filter(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    chosen = usable.distinct().orderBy(position, "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    runs = texts.select(position.alias("position"), F.col("quality").cast("int"), "text").mapInArrow(
        _runs, "position long, quality int, runs array<binary>"
    )
    one = runs.orderBy("position", "quality", "runs").limit(sample).coalesce(1)  # repeated ids may add rows
    weights = one.mapInArrow(_train, "weights binary").collect()
    if weights:
        return Network.unpack(bytes(weights[0]["weights"]))
    blank = Network.initial()
    blank.weights["mean_weights"][:] = blank.weights["max_weights"][:] = 0
    blank.weights["offset"][:] = 2
    return blank


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document."""
    packed = net.pack()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.unpack(packed)
        for batch in batches:
            scores = [own.score(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text reaches the threshold, with all their columns."""
    packed, at = net.pack(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.unpack(packed)
        for batch in batches:
            yield batch.filter(pa.array([own.score(text.as_py() or "") >= threshold for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
