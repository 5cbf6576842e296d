"""How the sources of a language differ in their words, by three-dimensional cube partitioning.

Terms are runs of A-Z, a-z and characters outside ASCII, with only A-Z lower-cased. Each language
keeps the terms in at least `DOCUMENTS` of its documents. A group (one source of a language), and the
language itself, gives each of the V kept terms p = 1 + floor(SCALE * (count + 1) / (N + V)), where
N sums its counts. f = floor((p - q)^2 / q) for the group's p and another q; all in whole numbers.

`pairs`: each group against each other source of its language, f summed over all kept terms.
`terms`: each group's terms that it uses more than its language does, by f.

Cube. The groups of a language fall into blocks of about `GROUPS` by hash, its kept terms into blocks
of about `TERMS`. A cell (group block, group block, term block) is a task's unit of work: it gets the slices
of its groups, that is their counts of the block's terms, and gives the partial sum of every pair of
its groups, in both directions. A slice goes to one cell for each group block. The partial
sums are added along the term axis. So no task holds a whole language, group or vocabulary; counts
are added up before anything is shuffled, and a source with a third of all rows is one row a term
like any other.

A term that neither group of a pair uses adds the same amount as all other such terms, so a cell needs
only their number. Null texts, languages and sources are ''. Groups without terms count; a language without kept terms
gives pairs of value 0 and no terms. Equal values rank by item in UTF-8 order. Repeated rows count as often as they occur. An
empty table gives an empty result. Other columns aren't read.

Bounds: N + V below 9.2 * 10^15 for each group, so that three digits at a time fit 63 bits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
#: Groups and terms of a block.
GROUPS = 64
TERMS = 8192
#: Keys that a language's terms are joined by.
SALTS = 128
#: Counters that a task holds before it passes them on.
HELD = 200_000

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_SPACED = bytes(b if b in _LETTERS else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(_SPACED).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, source, text; counts are passed on in parts."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[tuple, Counter] = defaultdict(Counter)
    since = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            size, also = len(own), documents[lang, source]
            columns = [[lang] * size, [source] * size, [t.decode("utf-8", "replace") for t in own]]
            numbers = [list(own.values()), [also[t] for t in own]]
            arrays = [*(pa.array(c, pa.string()) for c in columns), *(pa.array(c, pa.int64()) for c in numbers)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "documents"])
        counts.clear()
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
            found = terms_of(text)
            group = counts[lang, source]
            before = len(group)
            group.update(found)
            documents[lang, source].update(set(found))
            since += len(group) - before
            if since >= HELD:
                yield from flush()
                since = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents)"""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), three decimal digits at a time; count < total."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def partial_sums(low: list[tuple], high: list[tuple] | None, width: int) -> Iterator[tuple[str, str, int]]:
    """(source, other source, partial sum) of one cell; a slice is (source, N + V, term numbers, counts) and high is None
    where both blocks are the same; width: number of the term block's kept terms."""
    rows = low + (high or [])
    used = np.unique(np.concatenate([r[2] for r in rows]))
    p, unused = np.empty((len(rows), len(used)), np.int64), np.empty(len(rows), np.int64)
    for i, (_, total, numbers, counts) in enumerate(rows):
        unused[i] = share(np.zeros(1, np.int64), total)[0] if total else 1
        p[i] = unused[i]
        p[i, np.searchsorted(used, numbers)] = share(counts, total) if total else 1
    for i, (source, *_) in enumerate(rows):
        others = slice(0, len(rows)) if high is None else slice(len(low), len(rows)) if i < len(low) else slice(0, len(low))
        apart = p[i] - p[others]
        sums = (apart * apart // p[others]).sum(axis=1)
        sums += (width - len(used)) * ((unused[i] - unused[others]) ** 2 // unused[others])
        for (other, *_), value in zip(rows[others], sums.tolist()):
            if other != source:
                yield source, other, value


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, low, high, block, width, own, source, total, numbers, counts) lie sorted by cell."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            *plain, numbers, counts = batch.columns
            for i, values in enumerate(zip(*(c.to_pylist() for c in plain))):
                yield *values, numbers[i].values.to_numpy(), counts[i].values.to_numpy()

    for (lang, low, high, _, width), cell in groupby(rows(), lambda r: r[:5]):
        cell = list(cell)
        first = [r[6:] for r in cell if r[5] == low]
        second = [r[6:] for r in cell if r[5] == high] if low != high else None
        if not first or second == []:
            continue
        found = list(partial_sums(first, second, width))
        if found:
            source, other, value = zip(*found)
            arrays = [pa.array([lang] * len(found)), pa.array(source), pa.array(other), pa.array(value, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "item", "value"])


class Audit:
    """The two parts of the audit over one table."""

    def __init__(self, docs: DataFrame, documents: int = DOCUMENTS, group_block: int = GROUPS, term_block: int = TERMS):
        self.group_block, self.term_block = group_block, term_block
        counts = stored(term_counts(docs), "terms")
        totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents"))
        kept = totals.filter(F.col("documents") >= documents).select("lang", "term", "total")
        kept = stored(kept.withColumn("number", F.monotonically_increasing_id()), "kept")
        self.counts = stored(counts.drop("documents").join(kept, ["lang", "term"]), "counts")
        named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        sums = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
        groups = named.join(sums, ["lang", "source"], "left").withColumn("sum", F.coalesce("sum", F.lit(0)))
        groups = stored(groups, "groups")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("sum"))
        sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
        none = F.lit(0).cast("long")
        self.langs = sizes.join(langs, "lang", "left").select(
            "lang", "groups", F.coalesce("v", none).alias("v"), (F.coalesce("v", none) + F.coalesce("sum", none)).alias("lang_total")
        )
        self.kept = kept
        self.groups = groups.join(self.langs, "lang").withColumn("total", F.col("sum") + F.col("v"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value)"""
        term_blocks = F.greatest(F.ceil(F.col("v") / self.term_block), F.lit(1)).cast("int")
        group_blocks = F.ceil(F.col("groups") / self.group_block).cast("int")
        of_term = F.pmod(F.xxhash64("number"), F.col("term_blocks")).cast("int").alias("block")
        # a language is spread over several keys of these joins
        salt = F.pmod("number", F.lit(SALTS)).cast("int").alias("salt")
        shape = self.langs.select("lang", term_blocks.alias("term_blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        widths = self.kept.select("lang", "number", salt).join(shape, ["lang", "salt"]).groupBy("lang", of_term).agg(F.count(F.lit(1)).alias("width"))
        entries = self.counts.select("lang", "source", "number", "n", salt).join(shape, ["lang", "salt"]).withColumn("entry", F.struct("number", "n"))
        slices = entries.groupBy("lang", "source", of_term).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        every = self.groups.select(
            "lang", "source", "total", group_blocks.alias("group_blocks"), F.explode(F.sequence(F.lit(0), term_blocks - 1)).alias("block")
        )
        rows = every.join(widths, ["lang", "block"], "left").join(slices, ["lang", "source", "block"], "left")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("source"), "group_blocks").cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
        none = F.array().cast("array<long>")
        cells = rows.select(
            "lang",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "block",
            F.coalesce("width", F.lit(0)).alias("width"),
            "own",
            "source",
            "total",
            F.coalesce(F.col("entries.number"), none).alias("numbers"),
            F.coalesce(F.col("entries.n"), none).alias("counts"),
        )
        cell = ["lang", "low", "high", "block"]
        cells = cells.repartition(*cell).sortWithinPartitions(*cell)
        parts = cells.mapInArrow(_cells, "lang string, source string, item string, value long")
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """(lang, source, item, value), for terms that the group uses more than its language does."""

        def p(count: str, total: str):
            return F.expr(f"1 + ((cast({SCALE} as decimal(18,0)) * cast({count} + 1 as decimal(19,0))) div cast({total} as decimal(19,0)))")

        rows = self.counts.join(self.groups.select("lang", "source", F.col("total").alias("own_total"), "lang_total"), ["lang", "source"])
        rows = rows.withColumn("p", p("n", "own_total")).withColumn("q", p("total", "lang_total")).filter("p > q")
        return rows.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, top: int = TOP, **bounds: int) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs (part 'pair') and each group's first `top` terms (part 'term')."""
    parts = Audit(docs, **bounds)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.pairs().withColumn("rank", F.row_number().over(order))
    terms = parts.terms().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS documents FROM t GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(documents) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d
), sums AS (
  SELECT lang, source, coalesce(sum(c.n) FILTER (kept.term IS NOT NULL), 0) AS n
  FROM groups LEFT JOIN c USING (lang, source) LEFT JOIN kept USING (lang, term) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (sums.n + v) AS p,
    1 + (1000000000::HUGEINT * (total + 1)) // (langs.n + v) AS q
  FROM sums JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
