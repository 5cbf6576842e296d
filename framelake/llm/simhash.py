"""Near copies by SimHash, linked through a Gray-order hierarchical index.

Fingerprints. A text's A-Z are lower-cased, its words are runs of anything but ASCII white space,
its shingles all runs of three words (repeats included; all words if there are fewer). A bit of the
fingerprint is set if it is set in more than half of the shingles' XXH64 hashes (seed 42). Texts
without words, null texts included, have the fingerprint zero, which links like any other.

Links. Two fingerprints link if at most `DISTANCE` = 3 of their 64 bits differ.

Index. An upper node is a mask of bits and their values that all fingerprints below share. The
first layer has four masks of 16 bits: of four disjoint quarters, three differences leave one
untouched, so linked fingerprints share at least one first-layer node. A node with more than
`NODE` fingerprints is split the same way: its remaining bits fall into four parts, each of which
with the node's mask makes a child mask, and again linked fingerprints share a child. So no
node is ever compared whole with another; and as each layer shares a quarter of the bits left,
the last layer's nodes have at most 2^15 possible members. No fingerprint is dropped or capped.

Below those nodes a task takes the fingerprints sorted by Gray rank, in which neighbours share
long bit patterns, and factors each run of `FAN` into a node with the mask and the values of the
bits they share; then runs of those nodes, up to one root. Two nodes are joined from the root
downwards: the bits that both masks hold and that differ accumulate, and a pair of groups with more
than three differences is left whole. Pairs at the bottom are compared exactly.

Links between fingerprints that the task has connected already add nothing and are left out, so a
task gives fewer links than it has fingerprints, also for a dense group of near copies. Connected
components of the links give the groups.

Exact copies share one fingerprint and meet the index as one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stored

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a node that one task compares.
NODE = 2048
#: Bits of a mask from which on a node isn't split: it has at most 2^15 possible members.
FULL = 49
#: Nodes below a node of the Gray-order index.
FAN = 8
#: Rows that a task indexes together, and pairs of nodes that it expands together.
BUFFER = 32_768
PAIRS = 16_384
#: Shingles that are counted together.
COUNTED = 65_536

_PARTS = DISTANCE + 1


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    total, ones = max(1, len(words) - SHINGLE + 1), np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for low in range(0, total, COUNTED):
        part = np.fromiter(hashes, np.uint64, min(COUNTED, total - low))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "content", "fp"])


def content(docs: DataFrame) -> Column:
    """Hash of a whole row."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, content, fp): fp is the fingerprint as a signed long; one row for each row of docs."""
    rows = docs.select("doc_id", content(docs).alias("content"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, content long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order."""
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return ranks


def child_masks(mask: int) -> list[int]:
    """The mask with each of four disjoint parts of the bits it lacks."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    size = -(-len(free) // _PARTS)
    return [mask | sum(free[i : i + size]) for i in range(0, len(free), size)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _unsigned(value: int) -> int:
    return value & (1 << 64) - 1


def _children(mask: int) -> Column:
    return F.explode(F.array(*(F.lit(_signed(m)) for m in child_masks(mask))))


def nodes(distinct: DataFrame, node: int = NODE) -> DataFrame:
    """(mask, shared, fp): each fingerprint under every node that it has to be compared in."""
    level = distinct.select("fp", _children(0).alias("mask")).withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))
    ready = []
    while True:
        counts = level.groupBy("mask", "shared").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node)
        large = stored(counts.select("mask", "shared"), "nodes")
        masks = sorted(row["mask"] for row in large.select("mask").distinct().collect())  # at most 4^layer masks
        if not masks or min(_unsigned(mask).bit_count() for mask in masks) >= FULL:
            ready.append(level)
            break
        ready.append(level.join(large, ["mask", "shared"], "left_anti"))
        split = level.join(large, ["mask", "shared"], "left_semi")
        children = F.create_map(
            *(x for m in masks for x in (F.lit(m), F.array(*(F.lit(_signed(c)) for c in child_masks(_unsigned(m))))))
        )
        level = stored(
            split.select("fp", F.explode(children[F.col("mask")]).alias("mask")).withColumn(
                "shared", F.col("fp").bitwiseAND(F.col("mask"))
            ),
            "split",
        )
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out.select("mask", "shared", "fp")


class GrayIndex:
    """Hierarchical index of fingerprints that are sorted by (node key, Gray rank)."""

    def __init__(self, codes: np.ndarray, keys: np.ndarray):
        """keys: number of each fingerprint's upper node, ascending; only equal keys are compared."""
        same, low, high = np.full(len(codes), ~np.uint64(0)), keys, keys
        self.levels = [(codes, same, low, high)]
        while len(codes) > 1:
            at = np.arange(0, len(codes), FAN)
            all_, any_ = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
            same = np.bitwise_and.reduceat(same, at) & ~(all_ ^ any_)
            codes, low, high = all_, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((codes, same, low, high))

    def _close(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        codes, same, low, high = self.levels[level]
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        return near & (np.bitwise_count((codes[i] ^ codes[j]) & same[i] & same[j]) <= DISTANCE)

    def links(self) -> Iterator[tuple[int, int]]:
        """Positions of linked fingerprints; what is connected already may be left out."""
        n = len(self.levels[0][0])
        parent = np.arange(n)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step_i, step_j = (grid.ravel() for grid in np.divmod(np.arange(FAN * FAN), FAN))
        while stack:
            level, i, j = stack.pop()
            if len(i) > PAIRS:
                stack.append((level, i[PAIRS:], j[PAIRS:]))
                i, j = i[:PAIRS], j[:PAIRS]
            if level == 0:
                open_ = (i < j) & (parent[i] != parent[j])
                i, j = i[open_], j[open_]
                yield from self._join(parent, i, j)
                continue
            i, j = (i[:, None] * FAN + step_i).ravel(), (j[:, None] * FAN + step_j).ravel()
            size = len(self.levels[level - 1][0])
            inside = (i <= j) & (j < size)
            i, j = i[inside], j[inside]
            if level == 1:
                open_ = parent[i] != parent[j]
                i, j = i[open_], j[open_]
            near = self._close(level - 1, i, j)
            if near.any():
                stack.append((level - 1, i[near], j[near]))

    @staticmethod
    def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield a, b
        while not np.array_equal(parent, up := parent[parent]):
            parent[:] = up


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lie sorted by (mask, shared); nodes are indexed together until the buffer is full."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        mask, shared, codes = rows
        new = np.append(True, (mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1]))
        keys, codes = np.cumsum(new), codes.view(np.uint64)
        order = np.lexsort((gray_rank(codes), keys))
        codes, keys = codes[order], keys[order]
        pairs = np.array(list(GrayIndex(codes, keys).links()), np.int64).reshape(-1, 2)
        ends = codes.view(np.int64)[pairs]
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([column.to_numpy() for column in batch.columns]))
        if sum(part.shape[1] for part in held) >= BUFFER:
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
            if len(last):
                cut = last[-1] + 1
                yield links(rows[:, :cut])
                rows = rows[:, cut:]
            held = [rows]
    if held and (rows := np.concatenate(held, axis=1)).shape[1]:
        yield links(rows)


def links(distinct: DataFrame, node: int = NODE) -> DataFrame:
    """(a, b): links that connect what linked fingerprints connect; distinct has a column fp."""
    placed = nodes(distinct, node).repartition("mask", "shared").sortWithinPartitions("mask", "shared")
    return placed.mapInArrow(_compare, "a long, b long")


def groups(docs: DataFrame, node: int = NODE) -> DataFrame:
    """doc_id, content, fp, root, component_id for each row of docs.

    root: one fingerprint of the group, the same for all its rows. component_id: the smallest doc_id
    in the group (null if all are null).
    """
    marked = stored(fingerprints(docs), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = stored(components(links(distinct.select("fp"), node)), "roots")
    labelled = distinct.join(roots, distinct["fp"] == roots["vertex"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low"
    )
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    table = labelled.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(table, "fp").select("doc_id", "content", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each root of found (doc_id, content, root), with all its columns: that with the smallest
    doc_id (nulls come last), and of several such rows that with the smallest content hash; repeats of that row go."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("first")
    kept = found.groupBy("root").agg(first).select("first.content").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), content(docs).alias("content"))
    # equal rows have equal content, which is all that the texts are shuffled by
    return rows.join(kept, "content", "left_semi").groupBy("content").agg(F.first("row").alias("row")).select("row.*")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each group, as `one_of_each` chooses it."""
    return one_of_each(docs, groups(docs))
