"""Phrases whose words keep together, counted by counting quotient filters.

A-Z are lower-cased; texts are cut at `.,;:!?` and line breaks into pieces, those at spaces and tabs into
words. Per language (null: `und`) f(phrase) counts all occurrences of consecutive words within pieces, n all words. Candidates are the
phrases of 2 to 5 words with f >= `least`. A cut into two parts with counts l and r scores
floor(1000 * f * n / (l * r)), in exact integers; the lowest cut counts, ties to the earliest. Candidates
inside a longer candidate that is as frequent go; each language's first `top` stay.

Counting. A task reads texts into blocks: the words of about `TOKENS` positions of one language and their
places as block-local numbers, zero between pieces. Block vocabularies are added up; words with at
least `least` occurrences get dense numbers, which go back to the blocks that use them: a word's blocks are listed
where it is counted, and a task that reads the lists of such words sends each block one list of its numbers. No task holds the whole vocabulary. As a phrase is no more frequent than any part of it, blocks then
count only pairs of such words, and after that only longer phrases all of whose pairs are frequent.

A block's counts are a counting quotient filter (`quotient.py`): word numbers are packed, permuted
invertibly and cut into ranges of the permuted items. A range is merged across all blocks in one task, from sorted filters
into one that is exact, whose size follows from the number of ranges, which follows from the words of
the table (`ENTRIES` a range). The task also tells each block which of its pairs are frequent. A phrase that
fills a third of the table is one item of a block's filter like any other.

Null texts are empty; empty texts and languages without candidates give nothing; repeated rows count as often as they occur.
Equal scores and counts rank by phrase in UTF-8 order. Other columns aren't read.

Bounds: 2^25 - 1 frequent words in a language (more fail the job), and n below 10^17, so products fit
38 decimal digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import dense_index
from .quotient import MOST, Filter, halves, pack, permute, unpack
from .scratch import bucketed, stored

LEAST = 100
TOP = 2000
LONGEST = 5
#: Positions of a task's open blocks, and items of a range that one task merges.
TOKENS = 1 << 22
ENTRIES = 1 << 21
#: Places of a block whose items are counted at once, and bytes of filters that a task sends at once.
SLICE = 1 << 18
SENT = 1 << 22
#: Blocks of a bucket, on average.
BLOCKS = 4

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_PIECES = bytes(0x2E if b in _SEPARATORS else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words, with a full stop between pieces."""
    return (text or "").encode("utf-8", "replace").lower().translate(_PIECES).replace(b".", b" . ").split()


def _blocks(tokens: int):
    """Columns lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)

        def fresh() -> tuple[defaultdict, list[np.ndarray]]:
            vocabulary = defaultdict(count(0).__next__)
            vocabulary[b"."]
            return vocabulary, []

        held: dict[str, tuple[defaultdict, list[np.ndarray]]] = defaultdict(fresh)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (vocabulary, parts) in held.items():
                places = np.concatenate(parts)
                counts = np.bincount(places, minlength=len(vocabulary))
                words = [w.decode("utf-8", "replace") for w in list(vocabulary)[1:]]
                kind = np.uint16 if len(vocabulary) < 65_536 else np.uint32
                columns = [
                    pa.array([next(number)], pa.int64()),
                    pa.array([lang], pa.string()),
                    pa.array([words], pa.list_(pa.string())),
                    pa.array([counts[1:]], pa.list_(pa.int64())),
                    pa.array([kind().itemsize], pa.int32()),
                    pa.array([places.astype(kind).tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "lang", "words", "counts", "size", "places"])
            held.clear()

        for batch in batches:
            for lang, text in zip(*(column.to_pylist() for column in batch.columns)):
                words = words_of(text)
                if words:
                    vocabulary, parts = held[lang]
                    parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
                    parts.append(np.zeros(1, np.uint32))
                    size += len(words) + 1
                if size >= tokens:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, entries) of words to one row for each block of a batch: (block, local, number)."""
    for batch in batches:
        number, entries = batch.columns
        block, local = (x.to_numpy() for x in entries.flatten().flatten())
        number = np.repeat(number.to_numpy(), entries.value_lengths().to_numpy())
        order = np.argsort(block, kind="stable")
        block = block[order]
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))[: len(block)])
        edges = pa.array(np.append(at, len(block)), pa.int32())
        columns = [pa.ListArray.from_arrays(edges, pa.array(x[order], pa.int32())) for x in (local, number)]
        yield pa.RecordBatch.from_arrays([pa.array(block[at], pa.int64()), *columns], ["block", "local", "number"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block-local numbers to those of the language, a block at a time; rows (block, lang, size, places, length, local, number), the last two as lists of lists."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, _, size, places, length, local, number = (c[i] for c in batch.columns)
            table = np.zeros(length.as_py() + 1, np.uint32)
            table[local.values.flatten().to_numpy()] = number.values.flatten().to_numpy()
            out = table[np.frombuffer(places.as_buffer(), np.uint16 if size.as_py() == 2 else np.uint32)]
            made = pa.BinaryArray.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, out.nbytes], np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:2]), made], ["block", "lang", "places"])


def _rows(lang: pa.Scalar, block: pa.Scalar, slices: Iterator[Filter], bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each range of a block's items, whose slices are merged a range at a time."""
    parts = defaultdict(list)
    for found in slices:
        for r, part in found.ranges(bits):
            parts[r].append(part)
    ready: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        n = len(ready)
        columns = [
            pa.array([lang.as_py()] * n, pa.string()),
            pa.array([r for r, _ in ready], pa.int64()),
            pa.array([block.as_py()] * n, pa.int64()),
            pa.array([data for _, data in ready], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "range", "block", "filter"])

    for r in sorted(parts):
        ready.append((r, Filter.merged(parts.pop(r)).to_bytes(bits)))
        size += len(ready[-1][1])
        if size >= SENT:
            yield flush()
            ready, size = [], 0
    if ready:
        yield flush()


def pair_filters(places: np.ndarray, width: int, size: int = SLICE) -> Iterator[Filter]:
    """Pairs, by the slice of `size` places in which they begin."""
    for at in range(0, len(places), size):
        own = places[at : at + size + 1]
        both = (own[:-1] > 0) & (own[1:] > 0)
        a, b = (x[both].astype(np.uint64) for x in (own[:-1], own[1:]))
        yield Filter.of(*permute(a, b, width), width)


def phrase_filters(places: np.ndarray, pairs: list[Filter], width: int, size: int = SLICE) -> Iterator[Filter]:
    """Phrases of three and more words, all of whose pairs are in one of the filters, by the slice of `size` places in which they begin."""
    known = np.concatenate([high << np.uint64(32) | low for high, low in (f.items() for f in pairs)])
    known = np.append(np.sort(known), np.iinfo(np.uint64).max)
    for start in range(0, len(places), size):
        own = places[start : start + size + LONGEST - 1]
        wide = own.astype(np.uint64)
        wide = wide[:-1] << np.uint64(32) | wide[1:]
        frequent = known[np.searchsorted(known, wide)] == wide
        chain, found = frequent, []
        for n in range(3, LONGEST + 1):
            chain = chain[:-1] & frequent[n - 2 :]
            at = np.flatnonzero(chain[:size])
            found.append(pack(own[at[:, None] + np.arange(n)], width))
        high, low = (np.concatenate(x) for x in zip(*found))
        yield Filter.of(*permute(high, low, halves(width)), halves(width))


def _pairs(bits: int, width: int):
    """Rows (block, lang, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, places in zip(*batch.columns):
                yield from _rows(lang, block, pair_filters(_numbers(places), width), bits)

    return run


def _phrases(bits: int, width: int):
    """Rows (block, lang, places, filters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, places, filters in zip(*batch.columns):
                pairs = [Filter.from_bytes(f) for f in filters.as_py()]
                yield from _rows(lang, block, phrase_filters(_numbers(places), pairs, width), bits)

    return run


def _numbers(places: pa.Scalar) -> np.ndarray:
    return np.frombuffer(places.as_buffer(), np.uint32)


def _merged(least: int, bits: int, width: int, back: bool):
    """Rows (lang, range, block, filter) lie sorted by (lang, range). back: items are pairs, and each block is told which of its pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (lang, _), group in groupby(rows, lambda row: row[:2]):
            _, _, blocks, filters = zip(*group)
            filters = [Filter.from_bytes(f) for f in filters]
            frequent = Filter.merged(filters).at_least(least)
            if not len(frequent):
                continue
            high, low = frequent.items()
            words = np.stack((high, low), axis=1).astype(np.int64) if back else unpack(high, low, width)
            items = [w[w > 0].astype(np.int32) for w in words]
            n = len(items)
            columns = [pa.array([lang] * n), pa.array(items, pa.list_(pa.int32())), pa.array(frequent.count), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "ids", "a", "block", "filter"])
            if back:
                own = [(b, f) for b, f in ((b, f.within(frequent)) for b, f in zip(blocks, filters)) if len(f)]
                n = len(own)
                columns = [pa.array([lang] * n), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int64()), pa.array([b for b, _ in own]), pa.array([f.to_bytes(bits) for _, f in own])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "ids", "a", "block", "filter"])

    return run


class Counts:
    """The counts of one table: `vocabulary` (lang, word, a, number), `langs` (lang, n) and `phrases` (lang, ids, a)."""

    def __init__(self, docs: DataFrame, least: int = LEAST, tokens: int = TOKENS, entries: int = ENTRIES):
        rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
        kinds = "block long, lang string, words array<string>, counts array<long>, size int, places binary"
        blocks = stored(rows.mapInArrow(_blocks(tokens), kinds), "blocks")
        used = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry"))
        used = used.select("block", "lang", (F.col("at") + 1).alias("local"), F.col("entry.words").alias("word"), F.col("entry.counts").alias("n"))
        # a word's blocks are listed where it is counted, so the numbers go back without a join of the blocks' words
        entry = F.struct("block", "local")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        words = used.repartition(parts, "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("a"), F.collect_list(entry).alias("entries"))
        words = bucketed(words.filter(F.col("a") >= least), "words", parts, "lang", "word")
        self.langs = stored(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "langs")
        total = self.langs.agg(F.sum("n")).first()[0] or 0
        bits = max(0, (total // entries).bit_length())
        frequent = words.drop("entries").withColumn("order", F.xxhash64("word"))
        frequent = dense_index(frequent, ["order", "word"], F.shiftright("order", 48), "number", ["lang"])
        number = F.when(F.col("number") < MOST, F.col("number") + 1).otherwise(F.raise_error(F.lit("too many frequent words in a language")))
        self.vocabulary = stored(frequent.select("lang", "word", "a", number.cast("int").alias("number")), "vocabulary")
        most = self.vocabulary.agg(F.max("number")).first()[0] or 1
        width = int(most).bit_length()
        bits = min(bits, width)
        known = words.join(self.vocabulary.select("lang", "word", "number"), ["lang", "word"])
        known = known.select("number", "entries").mapInArrow(_by_block, "block long, local array<int>, number array<int>")
        # the places, by far most of the bytes, are dealt once: what comes later goes to their buckets
        buckets = min(max(1, blocks.count() // BLOCKS), 100_000)
        known = known.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("local", "number")).alias("known"))
        places = blocks.select("block", "lang", "size", "places", F.size("words").alias("length")).repartition(buckets, "block").join(known, "block")
        places = places.select("block", "lang", "size", "places", "length", "known.local", "known.number")
        numbered = bucketed(places.mapInArrow(_numbered, "block long, lang string, places binary"), "numbered", buckets, "block")
        pairs = self._merge(numbered.mapInArrow(_pairs(bits, width), _FILTERS), least, bits, width, True)
        back = pairs.filter("filter is not null").repartition(buckets, "block").groupBy("block").agg(F.collect_list("filter").alias("filters"))
        longer = numbered.join(back, "block").select("block", "lang", "places", "filters")
        longer = self._merge(longer.mapInArrow(_phrases(bits, width), _FILTERS), least, bits, width, False)
        self.phrases = pairs.filter("filter is null").unionByName(longer).select("lang", "ids", "a")

    @staticmethod
    def _merge(filters: DataFrame, least: int, bits: int, width: int, back: bool) -> DataFrame:
        sorted_ = filters.repartition("lang", "range").sortWithinPartitions("lang", "range")
        return stored(sorted_.mapInArrow(_merged(least, bits, width, back), "lang string, ids array<int>, a long, block long, filter binary"), "merged")


_FILTERS = "lang string, range long, block long, filter binary"


def scored(counts: Counts) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of every candidate, by its lowest cut."""
    size = F.size("ids")
    phrases = counts.phrases
    parts = phrases.unionByName(counts.vocabulary.select("lang", F.array("number").alias("ids"), "a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("*", F.slice("ids", 1, F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("ids").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("ids").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.join(counts.langs, "lang")
    wide = {c: f"cast({c} as decimal(19,0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"(cast(1000 * a as decimal(19,0)) * {wide['n']}) div ({wide['l']} * {wide['r']})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    found = cuts.groupBy("lang", "ids", "a", "n").agg(lowest)
    return found.select("lang", "ids", "a", "low.l", "low.r", "n", "low.score")


def inner(phrases: DataFrame) -> DataFrame:
    """(lang, ids, longer): the largest count of a longer candidate around each of its parts of two and more words."""
    size = F.size("ids")
    rows = phrases.filter(size > 2).withColumn("length", F.explode(F.sequence(F.lit(2), size - 1)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("length") + 1)))
    parts = rows.select("lang", F.slice("ids", F.col("at"), F.col("length")).alias("ids"), "a")
    return parts.groupBy("lang", "ids").agg(F.max("a").alias("longer"))


def _text(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds phrase."""
    words = found.select("lang", "ids", F.posexplode("ids").alias("at", "number")).join(vocabulary.select("lang", "number", "word"), ["lang", "number"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return found.join(words.groupBy("lang", "ids").agg(joined.alias("phrase")), ["lang", "ids"])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **bounds: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; each language's first `top`."""
    counts = Counts(docs, least, **bounds)
    found = scored(counts).join(inner(counts.phrases), ["lang", "ids"], "left")
    found = found.filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    order: list[Column] = [F.desc("score"), F.desc("a")]
    window = Window.partitionBy("lang")
    # all that tie with the last one stay until their phrases are known
    found = found.withColumn("place", F.rank().over(window.orderBy(*order))).filter(F.col("place") <= top)
    named = _text(stored(found, "found"), counts.vocabulary)
    named = named.withColumn("rank", F.row_number().over(window.orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
  SELECT lang, k, unnest([list_slice(words, i, i + k - 1) FOR i IN range(1, len(words) - k + 2)]) AS ids
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k
), f AS (
  SELECT lang, k, ids, count(*) AS a FROM grams GROUP BY ALL
), langs AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM f WHERE k > 1 AND a >= 100
), cuts AS (
  SELECT c.lang, c.ids, c.k AS size, c.a, cut, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.ids = list_slice(c.ids, 1, cut)
  JOIN f r ON r.lang = c.lang AND r.ids = list_slice(c.ids, cut + 1, c.k)
  JOIN langs ON langs.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ids ORDER BY score, cut) = 1
), parts AS (
  SELECT lang, a, unnest(flatten([[list_slice(ids, i, i + m - 1) FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS ids
  FROM candidates WHERE k > 2
), longer AS (
  SELECT lang, ids, max(a) AS most FROM parts GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, ids) WHERE most IS NULL OR most < a
), ranked AS (
  SELECT lang, array_to_string(ids, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM kept
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000
"""
