"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs are its lines, long ones in pieces of a sentence or a few. Their 64-bit
digests, each once, are the text's items. A sketch has three tables of cells; an item goes to one
cell of each, and a cell holds the number of its items, the exclusive or of their digests and that
of their check hashes. The fingerprint of a text is its sketch with `CELLS` cells a table, as text:
equal texts have equal fingerprints.

Two texts are compared by subtracting sketches cell by cell, which leaves the items that only one
of them has, and peeling: a cell that holds one item (its check hash tells) gives up that item,
which is taken from its other cells, and so on until all cells are empty. So that a sketch suits any
length, the items of a pair are first dealt by digest to parts of a few items, each with
sketches of its own. If a part can't be peeled, its sketches are built again with `GROWTH` times the
cells and other hashes, `RETRIES` times; for a part that even then has leftovers (two of its items would have
to meet in all cells of every size) the digests are compared. Likeness is the share of common items
among all items of both texts (1 if neither has any).

The edited version of a text replaces its last quarter by the beginning of the next document, in
order of doc_id (nulls first, repeated ids by text; the first follows the last). Documents are dealt
to ranges of ids, bounded by quantiles, and only the first document of each range visits another range.

Null texts count as empty. Repeated rows each give a row; the next of a repeated row is its repeat. A single
document is its own next one. No group is larger than one document's paragraphs.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import let

#: A piece takes this many characters of a line, then goes on to the end of the sentence or its last character.
PIECE, SENTENCE = 80, 160
CELLS = 10
#: Items of a part, for texts expected to share most of their items and for others.
EDITED_LOAD, NEXT_LOAD = 48, 16
GROWTH = 3
RETRIES = 2
#: Ranges of ids for each shuffle partition.
RANGES = 4
#: Rounds of peeling; in each, all cells with a single item give it up.
ROUNDS = 12

_PARAGRAPH = rf"[^\r\n]{{1,{PIECE}}}[^\r\n.!?]{{0,{SENTENCE}}}[.!?]*"


def items(text: Column) -> Column:
    """Digests of the paragraphs of a text, each once."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0)), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit("check"), digest)


def _placed(digest: Column, by: Column, cells: int) -> Column:
    """An item with its sign and its cell in each table; the hashes differ for each size."""
    hashed = F.xxhash64(F.lit(cells), digest)
    at = [F.pmod(F.shiftrightunsigned(hashed, 21 * t), F.lit(cells)).cast("int").alias(f"p{t}") for t in range(3)]
    return F.struct(by.alias("s"), digest.alias("d"), _check(digest).alias("c"), *at)


def _cell(n: Column, d: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), d.alias("d"), c.alias("c"))



def _gathered(placed: Column, cells: int) -> Column:
    """3 * cells cells with the items that fall into them."""
    nothing = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def add(cell: Column, item: Column) -> Column:
        return _cell(cell["n"] + item["s"], cell["d"].bitwiseXOR(item["d"]), cell["c"].bitwiseXOR(item["c"]))

    def tables(bound: Column) -> Column:
        def table(t: int) -> Column:
            def cell(at: Column) -> Column:
                return F.aggregate(F.filter(bound, lambda x: x[f"p{t}"] == at), nothing, add)

            return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), cell)

        return F.concat(*map(table, range(3)))

    return let(placed, tables)


def sketch(digests: Column, cells: int) -> Column:
    return _gathered(F.transform(digests, lambda d: _placed(d, F.lit(1), cells)), cells)


def _minus(one: Column, other: Column) -> Column:
    def take(a: Column, b: Column) -> Column:
        return _cell(a["n"] - b["n"], a["d"].bitwiseXOR(b["d"]), a["c"].bitwiseXOR(b["c"]))

    return F.zip_with(one, other, take)


def _is_empty(cell: Column) -> Column:
    return (cell["n"] == 0) & (cell["d"] == 0) & (cell["c"] == 0)


def _state(cells: Column, found: Column, stuck: bool) -> Column:
    return F.struct(cells.alias("cells"), found.alias("found"), F.lit(stuck).alias("stuck"))


def peeled(difference: Column, cells: int) -> Column:
    """Number of items in a difference of sketches; null if it can't be peeled."""
    def step(state: Column, _: Column) -> Column:
        def take(single: Column) -> Column:
            taken = F.transform(single, lambda x: _placed(x["d"], x["n"], cells))
            left = _minus(state["cells"], _gathered(taken, cells))
            found = state["found"] + F.size(single)
            return F.when(F.size(single) == 0, _state(state["cells"], state["found"], True)).otherwise(_state(left, found, False))

        single = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["d"])))
        return F.when(state["stuck"], state).otherwise(let(F.array_distinct(single), take))

    def count(state: Column) -> Column:
        return F.when(F.forall(state["cells"], _is_empty), state["found"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), _state(difference, F.lit(0), False), step, count)


def difference_size(one: Column, other: Column, cells: int = CELLS) -> Column:
    """How many digests are in one of two arrays only, by sketches that grow until they can be peeled."""
    attempts = []
    for _ in range(RETRIES + 1):
        attempts.append(peeled(_minus(sketch(one, cells), sketch(other, cells)), cells))
        cells *= GROWTH
    apart = F.size(F.array_except(one, other)) + F.size(F.array_except(other, one))
    return F.coalesce(*attempts, apart)


def printed(cells: Column) -> Column:
    """A sketch as text: the cells' counts and exclusive ors in hexadecimal digits."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(":", F.hex(x["n"]), F.hex(x["d"]), F.hex(x["c"]))), "-")


def _ranges(docs: DataFrame, key: Column) -> Column:
    """Number of the range of ids that a key falls into; ranges hold about as many rows each."""
    count = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / count for i in range(1, count)]
    bounds = docs.select(key.alias("key")).agg(F.percentile_approx("key", shares, 10 * count)).first()[0]
    bounds = sorted(set(bounds or []))
    step = max(1, isqrt(len(bounds)))  # bounds are looked up in two steps
    all_, coarse = (F.array(*map(F.lit, values)) if values else F.array().cast("array<long>") for values in (bounds, bounds[step - 1 :: step]))
    skipped = F.size(F.filter(coarse, lambda b: b <= key)) * step
    return skipped + F.size(F.filter(F.slice(all_, skipped + 1, F.lit(step)), lambda b: b <= key))


def with_next(docs: DataFrame) -> DataFrame:
    """(range, doc_id, text, next): each text with that of the next document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "key", F.coalesce("doc_id", F.lit(-(1 << 63)))
    )
    rows = rows.withColumn("range", _ranges(rows, F.col("key")))
    firsts = rows.groupBy("range").agg(F.min("key").alias("key"))
    # broadcast: a row for each range, of which there are RANGES for each shuffle partition
    heads = rows.join(F.broadcast(firsts), ["range", "key"]).groupBy("range").agg(F.min("text").alias("head"))
    over = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select(F.coalesce(F.lag("range").over(over), F.max("range").over(whole)).alias("before"), "range")
    follow = heads.join(before, "range").select(F.col("before").alias("range"), "head")
    order = Window.partitionBy("range").orderBy("key", "text")
    led = rows.withColumn("lead", F.lead("text").over(order))
    joined = led.alias("r").join(follow.alias("f"), (F.col("r.range") == F.col("f.range")) & F.col("r.lead").isNull(), "left")
    return joined.select("r.range", "r.doc_id", "r.text", F.coalesce("r.lead", "f.head").alias("next"))


def likeness(size: Column, difference: Column) -> Column:
    return F.when(size == 0, 1.0).otherwise((size - difference) / (size + difference))


def _entries(pair: int, parts: Column, name: str, own: bool) -> Column:
    """The items of one text of a pair, each with its part."""

    def entry(digest: Column) -> Column:
        return F.struct(
            F.lit(pair).alias("pair"),
            F.pmod(digest, parts).alias("part"),
            digest.alias("digest"),
            F.lit(own).alias("own"),
            F.lit(None).cast(_HEAD).alias("head"),
        )

    return F.transform(F.col(name), entry)


def compare_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 4)))"), F.substring("next", F.lit(1), cut))
    texts = with_next(docs).select(
        "range", "doc_id", size.cast("long").alias("n_chars"), "text", "next", edited.alias("edited")
    )
    rows = texts.select(
        "range",
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        *(items(F.col(c)).alias(c) for c in ("text", "edited", "next")),
    )
    pair = [
        _entries(number, F.greatest(F.lit(1), F.ceil((F.size("text") + F.size(other)) / load)), name, name == "text")
        for number, (other, load) in enumerate((("edited", EDITED_LOAD), ("next", NEXT_LOAD)))
        for name in ("text", other)
    ]
    head = F.struct(
        "doc_id", "n_chars", "edited_sha256", printed(sketch(F.col("text"), CELLS)).alias("fingerprint"),
        printed(sketch(F.col("edited"), CELLS)).alias("edited_fingerprint"),
        (F.size("text") + F.size("edited")).alias("size0"), (F.size("text") + F.size("next")).alias("size1"),
    )
    first = F.array(
        F.struct(
            F.lit(-1).alias("pair"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("digest"),
            F.lit(True).alias("own"), head.alias("head"),
        )
    )
    # all rows of a range are in one task from here on: grouping moves nothing
    entries = rows.select("range", "row", F.explode(F.concat(first, *pair)).alias("e")).select("range", "row", "e.*")
    parts = entries.groupBy("range", "row", "pair", "part").agg(
        F.collect_list(F.when(F.col("own"), F.col("digest"))).alias("one"),
        F.collect_list(F.when(~F.col("own"), F.col("digest"))).alias("other"),
        F.first("head", ignorenulls=True).alias("head"),
    )
    counted = parts.withColumn("apart", F.when(F.col("pair") >= 0, difference_size(F.col("one"), F.col("other"))).otherwise(0))
    found = counted.groupBy("range", "row").agg(
        F.first("head", ignorenulls=True).alias("head"),
        *(F.sum(F.when(F.col("pair") == n, F.col("apart")).otherwise(0)).alias(f"apart{n}") for n in (0, 1)),
    )
    return found.select(
        "head.doc_id",
        "head.n_chars",
        "head.edited_sha256",
        "head.fingerprint",
        "head.edited_fingerprint",
        likeness(F.col("head.size0"), F.col("apart0")).alias("near_edited"),
        likeness(F.col("head.size1"), F.col("apart1")).alias("near_next"),
    )


_HEAD = (
    "struct<doc_id: bigint, n_chars: bigint, edited_sha256: string, fingerprint: string, edited_fingerprint: string, "
    "size0: int, size1: int>"
)
