"""Packings: every token once, no overlap, no more sequences than needed."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from framelake.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check_places(rows, capacity):
    held = defaultdict(list)
    for row in rows:
        held[row.sequence_id].append((row.offset, row.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def exact_bins(lengths, capacity):
    """Smallest number of bins, by trying all placements."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + lengths[i] <= capacity:
                bins[j] += lengths[i]
                place(i + 1, bins)
                bins[j] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_shapes_use_each_piece_once_and_few_sequences():
    draw = random.Random(5)
    extra = 0
    for _ in range(120):
        lengths = [draw.randint(1, 20) for _ in range(draw.randint(1, 11))]
        shapes = packing.plan_shapes(Counter(lengths), 20)
        used = Counter()
        for copies, times in shapes:
            assert sum(n * length for length, n in copies) <= 20
            used.update({length: n * times for length, n in copies})
        assert used == Counter(lengths)
        extra += sum(times for _, times in shapes) - exact_bins(lengths, 20)
    assert extra <= 2


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [gap for gap in gaps if gap >= length]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else capacity) - length)
    return len(gaps)


def test_no_plan_is_worse_than_best_fit_decreasing():
    draw = random.Random(11)
    cases = [([draw.randint(520, 1020) for _ in range(1500)], 2048) for _ in range(2)]
    cases += [([draw.randint(1, top) for _ in range(draw.randint(1, 200))], 100) for top in (10, 35, 60, 100) for _ in range(15)]
    for lengths, capacity in cases:
        histogram = Counter(lengths)
        greedy = packing.best_fit_shapes(histogram, capacity)
        assert sum(times for _, times in greedy) == best_fit_decreasing(lengths, capacity)
        shapes = packing.plan_shapes(histogram, capacity)
        used = Counter()
        for copies, times in shapes:
            assert sum(n * length for length, n in copies) <= capacity
            used.update({length: n * times for length, n in copies})
        assert used == histogram
        assert sum(times for _, times in shapes) <= best_fit_decreasing(lengths, capacity)


def test_completion_wastes_least():
    draw = random.Random(3)
    for _ in range(300):
        counts = Counter(draw.randint(3, 30) for _ in range(draw.randint(1, 9)))
        gap = draw.randint(0, 60)
        filling = packing.completion(sorted(counts, reverse=True), counts, gap)
        assert not Counter(filling) - counts
        sums = {0}
        for length in counts.elements():
            sums |= {s + length for s in sums}
        assert sum(filling) == max(s for s in sums if s <= gap)


def test_completion_finds_the_exact_filling_that_best_fit_misses():
    assert sorted(packing.completion([6, 5, 4], {6: 1, 5: 1, 4: 1}, 9)) == [4, 5]


ROWS = [(i, "word " * (i * 7 % 50)) for i in range(300)] + [(7, "again"), (7, "again"), (900, None), (901, ""), (None, "x y")]


def test_pieces_hold_the_ids_of_the_library(documents):
    library = Tokenizer.from_file(VOCABULARY)
    special = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  y\n\n", "<|endoftext| >", "<<|endoftext|>>"]
    rows = [*ROWS, (1000, "A long text, isn't it?  Ünï \n\n " * 300), *enumerate(special, 2000)]
    found = packing.pack(documents(rows), RANKS, capacity=64, added=packing.added_tokens(VOCABULARY)).collect()
    expected = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(expected, key=repr)
    bins = check_places(found, 64)
    assert bins <= -(-sum(r.length for r in found) // 64) + 1


def test_empty_table_and_hot_length(documents):
    assert packing.pack(documents([]), RANKS).count() == 0
    found = packing.pack(documents([(i, "same text") for i in range(500)]), RANKS, capacity=10).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == 500
    assert check_places(found, 10) == -(-500 // (10 // found[0].length))


def test_numbering_is_dense_over_many_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 20)
    found = packing.pack(documents(ROWS), RANKS, capacity=64).collect()
    check_places(found, 64)
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
