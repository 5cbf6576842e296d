"""Near copies by MinHash bands, sequential Bayesian verification and exact comparison.

Sets. A text's A-Z are lower-cased, its words are runs of anything but ASCII white space, and its
set has the XXH64 hash of each distinct run of `shingle` words (of all words, if there are fewer).
Texts without words, null texts included, have the empty set, which is linked with nothing. Texts
with equal sets are one vertex from here on: identity is a 128-bit hash of the set, and the vertex
gets a number that is stored, so everything after it moves eight bytes.

Links. Two sets link if their Jaccard similarity is at least `similar`, a fraction of integers, so
no rounding decides. Groups are the connected components of the links.

Candidates. `bands` picks the number of bands for the rows of a band, so that a pair at the
threshold shares no band with a probability of at most `MISS`. The sets that share a band are a
bucket. Its members are compared by their sketches (one byte of each minimum) in batches: with a
uniform prior, the similarity after m matches of k has a Beta posterior, and a pair goes as soon as
the posterior probability of reaching the threshold falls below `MISS` (`Screen`). The rest may link;
a bucket gives a spanning forest of them, as stars that need no round of contraction for their length, never all pairs. Buckets above `ROWS` members are cut into
parts, and all their members count as one cluster.

Verification. Clusters are the connected components of what may link. A cluster is brought together
once, sketches and sets, in one cell, which screens all its pairs and counts the intersection of the
survivors exactly, but for pairs that are connected already. A cluster above `ROWS` sets or `HASHES`
hashes is cut into parts that share some sets (`BRIDGES`), so most of it connects at once; then the
sets outside the cluster's largest component meet all its sets, in cells of parts by parts, and only the
components that this connects are contracted once more. Every link is confirmed on full sets, and a link can only be missed with the probability `MISS`, once in the
bands and once in the screen. The work for a cluster grows with the sets outside its largest component times its
size: it is quadratic only where very many sets are close to the threshold and don't link.

Nulls, repeats and ties: rows keep their order of columns and number, a null doc_id belongs to its
text's group but isn't its smallest id, and equal rows stay equal rows. An empty table gives an
empty one. Other columns of the table aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stored

SHINGLE = 3
SIMILAR = (17, 20)
SEED = 42
#: Probability of losing a pair at the threshold, for the bands and for the screen.
MISS = 1e-6
#: Minima in a band.
BAND = 5
#: Minima that are compared before a pair is judged again.
BATCH = 24
#: Sets of a bucket or cluster, and hashes of a cluster, that one task compares with each other.
ROWS = 2048
HASHES = 4_194_304
#: Sets of a large cluster that all its parts share, on average.
BRIDGES = 64
#: Rows of buckets that a task compares together, and hashes whose minima are taken together.
BUFFER = 65_536
CHUNK = 2048


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, ascending."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64))


def bands(similar: tuple[int, int], rows: int = BAND, miss: float = MISS) -> int:
    """Bands that two sets at the threshold share none of with a probability of at most `miss`."""
    p, q = similar
    return math.ceil(math.log(miss) / math.log1p(-((p / q) ** rows)))


class Sketcher:
    """Minima of a set under `rows * count` random affine maps of its hashes."""

    def __init__(self, count: int, rows: int = BAND, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.count, self.rows = count, rows
        self.factor = draw.integers(0, 2**32, count * rows, np.uint32) | np.uint32(1)
        self.shift = draw.integers(0, 2**32, count * rows, np.uint32)

    def minima(self, found: np.ndarray) -> np.ndarray:
        folded = (found ^ found >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), 2**32 - 1, np.uint32)
        for low in range(0, len(folded), CHUNK):
            part = folded[low : low + CHUNK, None] * self.factor
            part += self.shift
            np.minimum(least, part.min(axis=0), out=least)
        return least

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One signed 64-bit key for each band."""
        parts = minima.reshape(self.count, self.rows)
        return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(parts)], np.uint64).view(np.int64)


class Screen:
    """Fewest matches of sketch bytes after each batch with which a pair may still link."""

    def __init__(self, size: int, similar: tuple[int, int], miss: float = MISS, batch: int = BATCH):
        p, q = similar
        level = p / q + (1 - p / q) / 256  # bytes of different minima are equal by chance
        self.ends = [*range(batch, size, batch), size]
        self.least = [self._fewest(k, level, miss) for k in self.ends]

    @staticmethod
    def _fewest(k: int, level: float, miss: float) -> int:
        """With a uniform prior, P(similarity >= level | m of k match) = P(Binomial(k + 1, level) <= m)."""
        below = 0.0
        for m in range(k + 1):
            ways = math.lgamma(k + 2) - math.lgamma(m + 1) - math.lgamma(k + 2 - m)
            below += math.exp(ways + m * math.log(level) + (k + 1 - m) * math.log1p(-level))
            if below >= miss:
                return m
        return k

    def passed(self, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of positions may link."""
        open_, matches, low = np.arange(len(i)), np.zeros(len(i), np.int32), 0
        for end, least in zip(self.ends, self.least):
            matches += (sketch[i[open_], low:end] == sketch[j[open_], low:end]).sum(axis=1, dtype=np.int32)
            stay = matches >= least
            open_, matches, low = open_[stay], matches[stay], end
        out = np.zeros(len(i), bool)
        out[open_] = True
        return out


class Forest:
    """Disjoint sets of positions."""

    def __init__(self, parent: np.ndarray):
        self.parent = parent

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def roots(self) -> np.ndarray:
        while not np.array_equal(self.parent, up := self.parent[self.parent]):
            self.parent = up
        return self.parent

    def join(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs that connect what isn't connected yet."""
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                yield a, b


def candidates(key: np.ndarray, sketch: np.ndarray, screen: Screen) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that may link; equal keys lie together, only those are compared."""
    forest, at, step, out = Forest(np.arange(len(key))), np.arange(len(key)), 1, []
    while len(at := at[at + step < len(key)]):
        at = at[key[at] == key[at + step]]
        roots = forest.roots()
        new = at[roots[at] != roots[at + step]]
        near = new[screen.passed(sketch, new, new + step)]
        out += forest.join(near, near + step)
        step += 1
    return out


def linked(
    sets: list[np.ndarray], sketch: np.ndarray, outside: np.ndarray, roots: np.ndarray, screen: Screen, similar: tuple[int, int]
) -> Iterator[tuple[int, int]]:
    """Links that connect positions with different roots, one of them outside; a pair is compared if the screen passes it."""
    p, q = similar
    n = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(n)))
    _, first = np.unique(roots, return_index=True)
    forest = Forest(first[np.unique(roots, return_inverse=True)[1]])
    held = np.zeros(int(column.max()) + 1 if len(column) else 1, np.int64)
    for x in np.flatnonzero(outside).tolist():
        now = forest.roots()
        other = np.flatnonzero((now != now[x]) & (q * np.minimum(n, n[x]) >= p * np.maximum(n, n[x])))
        other = other[screen.passed(sketch, np.full(len(other), x), other)]
        if not len(other):
            continue
        held[column[start[x] : start[x + 1]]] = 1
        common = np.array([held[column[start[y] : start[y + 1]]].sum() for y in other.tolist()])
        held[column[start[x] : start[x + 1]]] = 0
        near = other[(p + q) * common >= p * (n[other] + n[x])]
        yield from forest.join(np.full(len(near), x), near)


def _marked(shingle: int, sketcher: Sketcher, mark: Callable[[np.ndarray], int]):
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(3):
                found = shingles(text.as_py(), shingle)
                minima = sketcher.minima(found)
                bits = minima.astype(np.uint8).tobytes()
                keys = sketcher.keys(minima) if len(found) else np.zeros(0, np.int64)
                rows.append((xxhash.xxh3_128_digest(found.tobytes(), SEED), len(found), mark(found), bits, keys))
            made = [pa.array(own, kind) for own, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["doc_id", "c1", "c2", "code", "n", "fp", "sketch", "keys"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text.as_py(), shingle).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "found"])

    return run


def _by_key(keys: int, take: Callable[[pa.Table], pa.RecordBatch], rows: int = 0):
    """Runs take over whole groups of rows that agree in the first `keys` columns and lie together; rows: groups are taken
    together until there are so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def cuts(table: pa.Table) -> np.ndarray:
            new = np.zeros(max(table.num_rows - 1, 0), bool)
            for column in table.columns[:keys]:
                values = column.to_numpy()
                new |= values[1:] != values[:-1]
            return np.flatnonzero(new) + 1

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            table = pa.Table.from_batches(held)
            at = cuts(table).tolist()
            whole = table.num_rows if last else at[-1] if at else 0
            if rows and whole:
                yield take(table.slice(0, whole))
            elif whole:
                edges = [0, *[c for c in at if c < whole], whole]
                for a, b in zip(edges, edges[1:]):
                    yield take(table.slice(a, b - a))
            rest = table.slice(whole)
            held, count = rest.combine_chunks().to_batches() if rest.num_rows else [], rest.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
                if count >= rows:
                    yield from flush(False)
        if count:
            yield from flush(True)

    return run


def _bytes(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size)


def _stars(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    """What the pairs of positions connect: (first position, each other one), so that no chain is left to contract."""
    forest = Forest(np.arange(len(ids)))
    ends = np.array(found, np.int64).reshape(-1, 2)
    for _ in forest.join(ends[:, 0], ends[:, 1]):
        pass
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[roots[moved]]), pa.array(ids[moved])], ["a", "b"])


def _candidates(screen: Screen):
    """Rows (key, part, id, sketch)."""

    def take(table: pa.Table) -> pa.RecordBatch:
        key, part = table.column(0).to_numpy(), table.column(1).to_numpy()
        number = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        found = candidates(number, _bytes(table.column(3), screen.ends[-1]), screen)
        return _stars(table.column(2).to_numpy(), found)

    return _by_key(2, take, BUFFER)


def _linked(screen: Screen, similar: tuple[int, int]):
    """Rows (cluster, low, high, id, root, outside, sketch, found); gives the roots that links connect."""

    def take(table: pa.Table) -> pa.RecordBatch:
        roots = table.column(4).to_numpy()
        outside = table.column(5).to_numpy().astype(bool)
        sets = [np.frombuffer(x, np.uint64) for x in table.column(7).to_pylist()]
        found = list(linked(sets, _bytes(table.column(6), screen.ends[-1]), outside, roots, screen, similar))
        return _stars(roots, found)

    return _by_key(3, take)


def identity(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, c1 and c2."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns).alias("c1"), F.xxhash64(F.lit(1), *columns).alias("c2")]


def _number(*columns: str | Column) -> Column:
    return F.xxhash64(F.lit(7), *columns)


class Copies:
    """Steps of the search over one table; each is a DataFrame.

    similar, shingle: see above. rows, hashes: the bounds of a cell, smaller ones only for tests.
    """

    #: A number that a subclass keeps with each set.
    mark = staticmethod(len)

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, band: int = BAND, rows: int = ROWS, hashes: int = HASHES):
        self.docs, self.shingle, self.similar, self.rows, self.hashes = docs, shingle, similar, rows, hashes
        sketcher = Sketcher(bands(similar, band), band)
        self.screen = Screen(len(sketcher.factor), similar)
        kinds = "doc_id long, c1 long, c2 long, code binary, n long, fp long, sketch binary, keys array<long>"
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(docs), "text")
        self.marked = stored(texts.mapInArrow(_marked(shingle, sketcher, self.mark), kinds), "marked")
        firsts = self.marked.groupBy("code").agg(F.min(F.struct("c1", "c2", "n", "fp", "sketch", "keys")).alias("first"), F.min("doc_id").alias("low"))
        self.sets = stored(firsts.select(F.monotonically_increasing_id().alias("id"), "code", "low", "first.*"), "sets")

    def buckets(self) -> DataFrame:
        """(key, members, hub) of every band that two sets share."""
        keyed = self.sets.select("id", F.explode("keys").alias("key"))
        return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("hub")).filter("members > 1")

    def may_link(self) -> DataFrame:
        """(a, b): what a bucket connects, and what a bucket above the bound holds."""
        keyed = self.sets.select("id", F.explode("keys").alias("key"))
        members = stored(keyed.join(self.buckets(), "key"), "members")
        parts = F.ceil(F.col("members") / self.rows)
        placed = members.join(self.sets.select("id", "sketch"), "id")
        placed = placed.select("key", F.pmod(_number("id"), parts).cast("int").alias("part"), "id", "sketch")
        placed = placed.repartition("key", "part").sortWithinPartitions("key", "part", "id")
        found = placed.mapInArrow(_candidates(self.screen), "a long, b long")
        return found.unionByName(members.filter(F.col("members") > self.rows).select(F.col("hub").alias("a"), F.col("id").alias("b")))

    def found(self, ids: DataFrame) -> DataFrame:
        """(id, found) of some sets, made again from one text of each."""
        wanted = ids.join(self.sets.select("id", "c1", "c2"), "id").select("id", "c1", "c2")
        texts = self.docs.select(*identity(self.docs), "text").join(wanted, ["c1", "c2"]).select("id", "text")
        return texts.mapInArrow(_sets(self.shingle), "id long, found binary").dropDuplicates(["id"])

    def links(self) -> tuple[DataFrame, DataFrame | None]:
        """(vertex, root) of the sets that links within parts connect, and of those roots that other links connect, if clusters were cut."""
        clusters = components(self.may_link()).select(F.col("vertex").alias("id"), F.col("root").alias("cluster"))
        clusters = stored(clusters.join(self.sets.select("id", "n", "sketch"), "id"), "clusters")
        full = self.found(clusters.select("id"))
        size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes"))
        parts = F.greatest(F.ceil(F.col("size") / self.rows), F.ceil(F.col("hashes") / self.hashes)).cast("int")
        size = size.select("cluster", "size", parts.alias("parts"))
        large = stored(size.filter("parts > 1"), "large")
        several = not large.isEmpty()
        if several:
            full = stored(full, "full")  # read again for the second cells
        placed = clusters.join(size, "cluster")
        own = F.pmod(_number("id"), F.col("parts")).cast("int")
        bridge = (F.col("parts") > 1) & (F.pmod(_number(F.lit(1), "id"), F.col("size")) < BRIDGES)
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        first = placed.withColumn("low", F.explode(F.when(bridge, every).otherwise(F.array(own))))
        first = first.select("cluster", "low", F.lit(0).alias("high"), "id", F.col("id").alias("root"), F.lit(True).alias("outside"), "sketch")
        found = components(self._cells(first, full))
        if not several:
            return found, None
        found = stored(found, "found")
        return found, components(self._second(found, clusters, large, full))

    def _cells(self, placed: DataFrame, full: DataFrame) -> DataFrame:
        cells = placed.join(full, "id").select("cluster", "low", "high", "id", "root", "outside", "sketch", "found")
        cells = cells.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "id")
        return cells.mapInArrow(_linked(self.screen, self.similar), "a long, b long")

    def _second(self, found: DataFrame, clusters: DataFrame, large: DataFrame, full: DataFrame) -> DataFrame:
        """Of cut clusters: roots that links of the sets outside the largest component connect."""
        roots = found.select(F.col("vertex").alias("id"), "root")
        rows = clusters.join(large.select("cluster"), "cluster", "left_semi").join(roots, "id", "left")
        rows = stored(rows.withColumn("root", F.coalesce("root", "id")), "rooted")
        sizes = rows.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes"))
        best = F.max(F.struct("size", "root", "hashes")).alias("best")
        total = sizes.groupBy("cluster").agg(best, F.sum("size").alias("size"), F.sum("hashes").alias("hashes"))

        def parts(size: Column, hashes: Column) -> Column:
            return F.greatest(F.ceil(size / self.rows), F.ceil(hashes / self.hashes)).cast("int")

        rest = F.col("size") - F.col("best.size")
        total = total.filter(rest > 0).select(
            "cluster",
            F.col("best.root").alias("main"),
            parts(rest, F.col("hashes") - F.col("best.hashes")).alias("lows"),
            parts(F.col("size"), F.col("hashes")).alias("highs"),
        )
        rows = rows.join(total, "cluster")
        outside = rows.filter("root <> main").withColumn("low", F.pmod(_number("id"), "lows").cast("int"))
        outside = outside.withColumn("high", F.explode(F.sequence(F.lit(0), F.col("highs") - 1))).withColumn("outside", F.lit(True))
        inside = rows.withColumn("high", F.pmod(_number(F.lit(2), "id"), "highs").cast("int"))
        inside = inside.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("lows") - 1))).withColumn("outside", F.lit(False))
        kept = ["cluster", "low", "high", "id", "root", "sketch"]
        placed = outside.select(*kept, "outside").unionByName(inside.select(*kept, "outside"))
        placed = placed.groupBy("cluster", "low", "high", "id", "root", "sketch").agg(F.max("outside").alias("outside"))
        return self._cells(placed, full)

    def roots(self) -> DataFrame:
        """(code, low, n, root) of every set; low: smallest doc_id of its rows."""
        found, later = self.links()
        joined = self.sets.join(found, self.sets["id"] == found["vertex"], "left")
        joined = joined.select("code", "low", "n", F.coalesce("root", "id").alias("root"))
        if later is None:
            return joined
        joined = joined.join(later.select(F.col("vertex").alias("root"), F.col("root").alias("to")), "root", "left")
        return joined.select("code", "low", "n", F.coalesce("to", "root").alias("root"))


def groups(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, rows: int = ROWS, hashes: int = HASHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    component_id: the smallest doc_id that links reach, itself included; a row without words is linked with nothing.
    kept: whether it is the row's own doc_id (null counts as its own if the group has no other).
    """
    copies = Copies(docs, shingle, similar, rows=rows, hashes=hashes)
    roots = stored(copies.roots(), "roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    found = roots.join(lowest, "root").select("code", "component_id")
    rows_ = copies.marked.select("doc_id", "code", "n").join(found, "code")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows_.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
