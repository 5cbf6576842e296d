"""Packing of token sequences by bin completion.

Only the lengths decide a packing, and there are at most `capacity` of them. So the cluster counts
the pieces of each length, the driver plans on that histogram (at most `capacity` rows, whatever
the input), and the cluster gives each piece its place: the n-th piece of a length goes to the n-th
place that the plan has for that length.

The plan fills one sequence shape at a time around the largest length left. Branch and bound
enumerates the fillings of the gap, largest lengths first, with the best-fit filling as the first
incumbent. The waste bound of a branch is exact: which sums the lengths still to come can reach is
kept as a set of bits, so a branch is entered only if it ends with the least waste there is, and no
limit on the number of branches is needed. The first such filling is not dominated: one in which a
length stands for several of them would have come before it. A shape is used as often as the counts
allow, so the number of shapes follows the number of lengths. Least waste in each sequence need not
mean fewest sequences, so best-fit decreasing plans the same histogram too, and the plan with fewer
sequences is taken.

Ids are those of the rank file. The strings of `added` tokens (see `added_tokens`) are found first and
become their own ids; the text between them is encoded piece by piece, as the tokenizer library does.

A document's ids are followed by the separator id. A document above the capacity is cut into pieces
of `capacity` tokens, of which the first may be shorter. Null texts count as empty and give one
piece that holds the separator. Repeated rows each give their pieces; an empty table gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import stored

CAPACITY = 2048
SEPARATOR = 0
#: Rows that one numbering task sorts, about.
ROWS_PER_TASK = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Shapes of sequences: ([(length, copies)], number of sequences).
Shapes = list[tuple[list[tuple[int, int]], int]]


def added_tokens(vocabulary_file: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON file, which the library finds in texts before it splits them."""
    with open(vocabulary_file, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for token in tokens:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} depends on the text around it")
    return {token["content"]: token["id"] for token in tokens}


def _cut(rank_file: str, capacity: int, separator: int, added: dict[str, int]):
    end = separator.to_bytes(4, "little")
    own = {token: number.to_bytes(4, "little") for token, number in added.items()}
    strings = "|".join(map(re.escape, sorted(own, key=len, reverse=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, split = encoder(rank_file).encode, re.compile(f"({strings})").split

        def encode(text: str) -> bytes:
            parts = split(text) if own else [text]
            return b"".join(own.get(part) or ordinary(part) for part in parts)

        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, text in zip(*batch.columns):
                ids = encode(text.as_py() or "") + end
                count = len(ids) // 4
                low, high = 0, (count - 1) % capacity + 1
                for piece in range(-(-count // capacity)):
                    out["doc_id"].append(doc_id.as_py())
                    out["piece"].append(piece)
                    out["start"].append(low)
                    out["length"].append(high - low)
                    out["ids_crc32"].append(zlib.crc32(memoryview(ids)[4 * low : 4 * high]))
                    low, high = high, high + capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return run


def token_pieces(
    docs: DataFrame,
    rank_file: str,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    added: dict[str, int] | None = None,
) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_cut(rank_file, capacity, separator, added or {}), PIECES)


def _reachable(lengths: list[int], counts: dict[int, int], gap: int) -> list[int]:
    """For each index the sums, up to the gap, of the lengths from it on, as bits."""
    inside = (1 << (gap + 1)) - 1
    sums = [1]
    for length in reversed(lengths):
        bits, left, some = sums[-1], min(counts[length], gap // length), 1
        while left:  # powers of two and a rest give every number of copies
            some = min(some, left)
            bits |= (bits << some * length) & inside
            left, some = left - some, 2 * some
        sums.append(bits)
    return sums[::-1]


def completion(lengths: list[int], counts: dict[int, int], gap: int) -> list[int]:
    """The lengths that fill `gap` with the least waste, larger ones first; `lengths` is sorted downwards."""
    incumbent: list[int] = []
    room = gap
    for length in lengths:  # best fit
        take = min(room // length, counts[length])
        incumbent += [length] * take
        room -= take * length
        if not room:
            return incumbent
    sums = _reachable(lengths, counts, gap)

    def bound(index: int, room: int) -> int:
        """The least waste that a branch can end with."""
        return room - (sums[index] & ((1 << (room + 1)) - 1)).bit_length() + 1

    least = bound(0, gap)
    if least == room:
        return incumbent
    best, room = [], gap
    for index, length in enumerate(lengths):
        if room == least:
            break
        most = min(room // length, counts[length])
        take = next(n for n in range(most, -1, -1) if bound(index + 1, room - n * length) == least)
        best += [length] * take
        room -= take * length
    return best


def completion_shapes(histogram: dict[int, int], capacity: int) -> Shapes:
    """Bin completion: each shape is the least wasteful one around the largest length left."""
    counts = {length: count for length, count in histogram.items() if count > 0}
    lengths = sorted(counts, reverse=True)
    shapes = []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        rest = lengths if counts[top] else lengths[1:]
        first = next((i for i, length in enumerate(rest) if length <= capacity - top), len(rest))
        filling = completion(rest[first:], counts, capacity - top)
        counts[top] += 1
        copies: dict[int, int] = {top: 1}
        for length in filling:
            copies[length] = copies.get(length, 0) + 1
        times = min(counts[length] // n for length, n in copies.items())
        for length, n in copies.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
                lengths.remove(length)
        shapes.append((list(copies.items()), times))
    return shapes


def best_fit_shapes(histogram: dict[int, int], capacity: int) -> Shapes:
    """Best-fit decreasing, for sequences of the same filling at once."""
    filled: dict[int, Shapes] = {0: []}  # by the gap that is left
    gaps: list[int] = []  # those that still take something, upwards
    for length in sorted((n for n, count in histogram.items() if count > 0), reverse=True):
        count = histogram[length]
        while count:
            at = bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else capacity
            filling, times = filled[gap].pop() if at < len(gaps) else ([], count)
            if at < len(gaps) and not filled[gap]:
                gaps.pop(at)
            copies = min(gap // length, count)
            used = min(times, count // copies)
            count -= copies * used
            rest = [(gap, filling, times - used)] if filling and times > used else []
            for left, shape, n in [*rest, (gap - copies * length, [*filling, (length, copies)], used)]:
                if left and not filled.get(left):
                    insort(gaps, left)
                filled.setdefault(left, []).append((shape, n))
    return [shape for shapes in filled.values() for shape in shapes]


def plan_shapes(histogram: dict[int, int], capacity: int) -> Shapes:
    """The plan with fewer sequences; bin completion's if both have as many."""
    plans = (completion_shapes(histogram, capacity), best_fit_shapes(histogram, capacity))
    return min(plans, key=lambda shapes: sum(times for _, times in shapes))


def plan_places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, past, sequence, copies, offset): pieces first .. past - 1 of the length go to
    the sequences from `sequence` on, `copies` into each, from `offset` on."""
    seen: dict[int, int] = {}
    sequence, places = 0, []
    for copies, times in plan_shapes(histogram, capacity):
        offset = 0
        for length, n in copies:
            first = seen.get(length, 0)
            seen[length] = first + n * times
            places.append((length, first, seen[length], sequence, n, offset))
            offset += n * length
        sequence += times
    return places


def numbered(pieces: DataFrame, rows: int) -> DataFrame:
    """Adds `nth`, from 0 and dense within each length. No task sorts a whole length."""
    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_TASK)
    cut = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("length").orderBy("part")
    before = counts.select(
        "length", "part", (F.sum("n").over(by_length) - F.col("n")).alias("before")
    )
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(order) - 1)
    return ranked.join(before, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")


def _place_column(places: Column, nth: Column) -> Column:
    return F.filter(places, lambda p: (p["first"] <= nth) & (nth < p["past"]))[0]


def pack(
    docs: DataFrame,
    rank_file: str,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(token_pieces(docs, rank_file, capacity, separator, added), "pieces")
    spark = docs.sparkSession
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # <= capacity rows
    by_length: dict[int, list] = {}
    for length, *place in plan_places(histogram, capacity):
        by_length.setdefault(length, []).append(tuple(place))
    table = spark.createDataFrame(
        list(by_length.items()),
        "length long, places array<struct<first: long, past: long, sequence: long, copies: long, offset: long>>",
    )
    placed = numbered(pieces, sum(histogram.values())).join(F.broadcast(table), "length")  # <= capacity rows
    place, nth = F.col("place"), F.col("nth")
    within = nth - place["first"]
    return placed.withColumn("place", _place_column(F.col("places"), nth)).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (place["sequence"] + F.floor(within / place["copies"])).cast("long").alias("sequence_id"),
        (place["offset"] + F.pmod(within, place["copies"]) * F.col("length")).cast("long").alias("offset"),
    )
