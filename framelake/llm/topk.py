"""Exact top-k by inner product with an impact-ordered index, score at a time.

Components become integers, floor(scale * x). Vectors are dealt evenly into blocks, queries into
chunks and those into a few ranges. A tile, the pair of a block and a range, is searched by one task: it
builds the block's index once and takes the range chunk by chunk. Blocks and chunks travel as small packs, which are
copied for their tiles one at a time, so no task holds more than a block and a few packs, however many there
are. The index of a block has a posting list for each dimension, in which the vectors stand by descending size of their
component: the impact. A query takes the lists' segments by descending quantised impact, that is in
rounds whose threshold halves, and adds what each posting gives to the score of its vector. A
posting not yet seen adds between minus and plus the threshold, so every vector has a lower and an upper bound on its
score. The search stops when few vectors have an upper bound that reaches the k-th best lower bound:
no other vector can be a member, however the rest turns out. These possible members are scored
exactly. If bounds never separate, all postings are read and the scores are exact. Each block gives
its own k best for each query; the best k of these are the result.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.
Missing components of shorter vectors count as zero. Ties go to the smaller id. Repeated ids are rows
of their own: a query isn't its own candidate, but a repeat of it is. Where sums might pass 64 bits a
query is searched with integers of any size. A component that doesn't fit `LARGEST`, or a result's score
that doesn't fit 64 bits, has no place in the output's types: it fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

K = 20
SCALE = 64
#: Every row whose id is divisible by this is a query.
EVERY = 20
BLOCK = 32_768
CHUNK = 512
#: A block and a pack have so many components at most, which bounds their bytes at any number of dimensions.
BLOCK_COMPONENTS, PACK_COMPONENTS = 1 << 22, 1 << 15
#: A block goes to so many tasks at most; where there are more tiles than `TASKS`, a task takes several, one after the other.
RANGES, TASKS = 8, 8_192
LARGEST = 1 << 62
#: The first threshold is the largest impact divided by this.
FIRST = 16
#: Possible members are scored once there are at most this many for each wanted one.
MEMBERS = 128


class ImpactIndex:
    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.int64)
        size, dims = vectors.shape
        order = np.argsort(-np.abs(self.vectors), axis=0, kind="stable")
        self.ids = np.ascontiguousarray(order.T)
        #: The count of postings seen is kept in the low bits of a score.
        self.shift = int(dims).bit_length()
        values = np.ascontiguousarray(np.take_along_axis(self.vectors, order, 0).T)
        self.impacts = -np.abs(values)  # ascending
        #: Sums in 32 bits wherever they fit take a third of the time.
        self.values = values.astype(np.int32) if np.abs(values).max(initial=0) < 1 << 31 else values
        self.largest = -self.impacts[:, 0] if size else np.zeros(dims, np.int64)

    def search(self, query: np.ndarray, k: int, own: int = -1) -> np.ndarray:
        """Positions of all vectors that may be among the k best, `own` aside."""
        size, dims = self.vectors.shape
        weights = np.abs(query)
        products = weights.astype(object) * self.largest.astype(object)  # of any size
        used = np.flatnonzero(products)
        reach = (int(products.sum()) << self.shift) + dims
        kind, wide = (object, object) if reach >= LARGEST else (np.int32 if reach < 1 << 31 else np.int64, np.int64)
        scores = np.full(size, dims - len(used), kind)  # unused dimensions add nothing: seen
        done = dict.fromkeys(used.tolist(), 0)
        tau = max(products.tolist(), default=0) // FIRST
        query = query.astype(wide) << self.shift
        query, one = query.astype(kind), 1 if kind is object else kind(1)
        seen = (1 << self.shift) - 1
        while True:
            for d, low in done.items():
                # postings with an impact above tau
                least = min(tau // int(weights[d]), LARGEST)
                high = int(np.searchsorted(self.impacts[d], -least, "left")) if tau else size
                if high > low:
                    values = self.values[d, low:high]
                    values = values.astype(object) if kind is object else values
                    np.add.at(scores, self.ids[d, low:high], values * query[d] + one)
                    done[d] = high
            slack = (dims - (scores & seen)).astype(wide) * tau
            middle = (scores >> self.shift).astype(wide)
            lower, upper = middle - slack, middle + slack
            if own >= 0:
                lower[own] = upper[own] = -4 * reach if wide is object else np.iinfo(np.int64).min
            others = size - (own >= 0)
            if others <= k:
                return np.flatnonzero(np.arange(size) != own)
            members = np.flatnonzero(upper >= np.partition(lower, size - k)[size - k])
            if not tau or len(members) <= MEMBERS * k:
                return members[members != own]
            tau //= 2

    def best(self, query: np.ndarray, k: int, ids: np.ndarray, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best, ties by id, then by position."""
        members = self.search(query, k, own)
        scores = self._exact(members, query)
        if scores.dtype != object:
            order = np.lexsort((members, ids[members], -scores))[:k]
            return members[order], scores[order]
        order = np.array(sorted(range(len(members)), key=lambda i: (-scores[i], ids[members[i]], members[i])), int)[:k]
        if any(abs(score) >= 1 << 63 for score in scores[order]):
            raise OverflowError("a score passes 64 bits; use a smaller scale")
        return members[order], scores[order].astype(np.int64)

    def _exact(self, members: np.ndarray, query: np.ndarray) -> np.ndarray:
        bound = sum(map(int.__mul__, np.abs(query).tolist(), self.largest.tolist()))
        if bound < LARGEST:
            return self.vectors[members] @ query
        return self.vectors[members].astype(object) @ query.astype(object)


def integers(vector: Column, scale: int) -> Column:
    def integer(x: Column) -> Column:
        scaled = x.cast("double") * scale
        too_large = F.raise_error(F.lit("a component is too large for 64-bit integers; use a smaller scale")).cast("long")
        return F.when(F.abs(scaled) < float(LARGEST), F.floor(scaled)).otherwise(too_large)

    return F.transform(vector, integer)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


_PACK = "tile long, asks boolean, rows binary, ids binary, vectors binary"


def _packed(size: int, dims: int, asks: bool, tiles: Callable[[int], range]):
    """Packs the rows of a partition (row, vec_id, values), `size` at a time, and gives each pack once for each of the partition's tiles.

    Copies leave one by one; `explode` would hold all copies of a pack at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = tiles(TaskContext.get().partitionId())
        held, count = [], 0
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            matrix = np.zeros((batch.num_rows, dims), "<i8")
            matrix[np.arange(dims) < lengths[:, None]] = flat
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix))
            count += batch.num_rows
            if count >= size:
                parts = [np.concatenate(parts) for parts in zip(*held)]
                full = count - count % size
                for at in range(0, full, size):
                    yield from _copies(to, asks, *(part[at : at + size] for part in parts))
                held, count = [[part[full:] for part in parts]], count - full
        if count:
            yield from _copies(to, asks, *(np.concatenate(parts) for parts in zip(*held)))

    return run


def _copies(tiles: range, asks: bool, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    fields = {"rows": [rows.tobytes()], "ids": [ids.tobytes()], "vectors": [_smallest(matrix).tobytes()]}
    for tile in tiles:
        yield pa.RecordBatch.from_pydict({"tile": [tile], "asks": [asks]} | fields)


def _smallest(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integers that hold them all."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return matrix.astype(f"<i{width}")


def _unpacked(dims: int, rows: bytes, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
    return rows, ids, np.frombuffer(vectors, f"<i{len(vectors) // (len(rows) * dims)}").reshape(-1, dims)


def _searched(k: int, dims: int):
    """Answers of the packs of a partition, sorted by tile, those of the block first."""

    def answers(index: ImpactIndex, place: dict[int, int], rows: np.ndarray, ids: np.ndarray, asked: tuple) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for row, query_id, query in zip(asked[0], asked[1], asked[2].astype(np.int64)):
            found, scores = index.best(query, k, ids, place.get(int(row), -1))
            for column, part in zip(
                out, (np.full(len(found), row), np.full(len(found), query_id), rows[found], ids[found], scores)
            ):
                column.append(part)
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        return pa.RecordBatch.from_pydict({n: np.concatenate(c) for n, c in zip(names, out)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, block, parts = None, None, []
        for batch in batches:
            for at in range(batch.num_rows):
                number, asks, *pack = (column[at].as_py() for column in batch.columns)
                if number != tile:
                    tile, block, parts = number, None, []
                pack = _unpacked(dims, *pack)
                if not asks:
                    parts.append(pack)
                    continue
                if parts:
                    rows, ids, vectors = (np.concatenate(part) for part in zip(*parts))
                    block = ImpactIndex(vectors), {row: at for at, row in enumerate(rows.tolist())}, rows, ids
                    parts = []
                if block:
                    yield answers(*block, pack)

    return run


def search(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query."""
    rows = stored(
        vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long").alias("vec_id"),
            integers(F.col("embedding"), scale).alias("values"),
        ),
        "vectors",
    )
    is_query = F.col("vec_id") % every == 0
    count, queries, dims = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("values"))).first()
    dims = max(1, dims or 1)
    block, pack = min(block, BLOCK_COMPONENTS // dims or 1), PACK_COMPONENTS // dims or 1
    chunk = min(chunk, pack)
    blocks, chunks = -(-count // block) or 1, -(-queries // chunk) or 1
    ranges = min(chunks, RANGES)
    tiles = blocks * ranges
    packed = rows.repartition(blocks).mapInArrow(
        _packed(min(block, pack), dims, False, lambda part: range(part % blocks * ranges, (part % blocks + 1) * ranges)), _PACK
    )
    asked = rows.filter(is_query).repartition(chunks).mapInArrow(
        _packed(chunk, dims, True, lambda part: range(part % ranges, tiles, ranges)), _PACK
    )
    tasks = min(tiles, TASKS)
    dealt = packed.unionAll(asked).repartitionById(tasks, (F.col("tile") % tasks).cast("int"))
    found = dealt.sortWithinPartitions("tile", "asks").mapInArrow(
        _searched(k, dims), "query_row long, query_id long, row long, vec_id long, score long"
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
