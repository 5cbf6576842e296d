"""Groups against the Jaccard similarity of all pairs, and the two screens by themselves."""

import random
from fractions import Fraction

import numpy as np
import pytest

from framelake.llm import minhash
from framelake.llm.queries import QUERIES


def plain_set(text, shingle=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def plain_groups(rows, shingle=3, least=Fraction(85, 100)):
    """(doc_id, set size, smallest doc_id reachable, kept), over all pairs."""
    sets = [plain_set(t, shingle) for _, t in rows]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and a and b and Fraction(len(a & b), len(a | b)) >= least:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for (doc_id, _), own, g in zip(rows, sets, group):
        low = min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None)
        out.append((doc_id, len(own), low if own else doc_id, doc_id == (low if own else doc_id)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def edge_texts():
    draw = random.Random(5)
    texts = []
    for size, edits, copies in ((30, 1, 8), (80, 4, 30), (300, 12, 12)):
        words = [f"w{draw.randrange(3000)}" for _ in range(size)]
        for _ in range(copies):
            own = list(words)
            for _ in range(draw.randint(0, edits)):
                own[draw.randrange(size)] = f"e{draw.randrange(10**6)}"
            texts.append(" ".join(own))
    line = " ".join(f"line{i}" for i in range(20))
    texts += [f"{line} " + " ".join(f"x{draw.randrange(10**6)}" for _ in range(6)) for _ in range(40)]
    # n shingles, and one more: 17/20 exactly can't be, but 6/7 links and 5/6 doesn't
    texts += [" ".join(f"{k}{i}" for i in range(n + 2 + more)) for k, n in (("p", 6), ("q", 5)) for more in (0, 1)]
    # 17 of 20 shingles in common, exactly at the threshold: the second text is a part of the first
    texts += [" ".join(f"s{i}" for i in range(22)), " ".join(f"s{i}" for i in range(19))]
    return texts + [None, "", " \n\t", "a b", "A  b", "a b c", "a\x0bB\x0cc", "É é ü", "é é ü", "rep " * 500, "rep rep rep", "word " * 3 + "x " * 60_000]


@pytest.mark.parametrize("bounds", [{}, {"rows": 3}, {"hashes": 400}, {"rows": 7, "hashes": 900}])
def test_groups_equal_all_pairs(documents, bounds):
    texts = edge_texts()
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(3000, texts[9]), (3000, texts[9]), (3001, texts[9])]
    assert rows_of(minhash.groups(documents(rows), **bounds)) == plain_groups(rows)


def test_null_ids_repeats_and_other_columns(spark):
    rows = [(None, "one two three"), (None, "four five six"), (5, "one two THREE"), (5, "one two three"), (None, None), (7, "")]
    docs = spark.createDataFrame([(t, i, 1, b"x", "y") for i, t in rows], "text string, doc_id long, code int, sketch binary, `a.b` string")
    assert rows_of(minhash.groups(docs)) == sorted(
        [(None, 1, 5, False), (None, 1, None, True), (5, 1, 5, True), (5, 1, 5, True), (None, 0, None, True), (7, 0, 7, True)], key=repr
    )


def test_an_empty_table(documents):
    assert minhash.groups(documents([])).count() == 0


def test_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_minhash"](spark, sf)) == plain_groups(rows)


@pytest.mark.parametrize("similar", [(17, 20), (4, 5), (1, 2)])
def test_bands_and_screen_keep_their_miss_probability(similar):
    p, q = similar
    rows = 5
    count = minhash.bands(similar, rows)
    assert (1 - (p / q) ** rows) ** count <= minhash.MISS < (1 - (p / q) ** rows) ** (count - 1)
    screen = minhash.Screen(rows * count, similar)
    draw = np.random.default_rng(1)
    size, pairs = rows * count, 20_000
    sketch = draw.integers(0, 256, (2 * pairs, size), np.uint8)
    i, j = np.arange(pairs), np.arange(pairs, 2 * pairs)
    equal = draw.random((pairs, size)) < p / q
    sketch[j] = np.where(equal, sketch[i], sketch[j])
    assert screen.passed(sketch, i, j).all()
    assert not screen.passed(sketch, i, np.roll(j, 1)).any()  # unrelated


def test_minima_estimate_similarity():
    draw = np.random.default_rng(2)
    sketcher = minhash.Sketcher(minhash.bands((17, 20)))
    for share in (0.3, 0.6, 0.9):
        common, rest = int(2000 * share), 2000 - int(2000 * share)
        own = [draw.integers(0, 2**63, rest).astype(np.uint64) for _ in range(2)]
        both = draw.integers(0, 2**63, common).astype(np.uint64)
        a, b = (sketcher.minima(np.concatenate((both, x))) for x in own)
        assert abs((a == b).mean() - common / (common + 2 * rest)) < 0.15


def test_a_crowd_of_unlinked_texts_gives_no_link(documents):
    """All share a passage and none links; cut into parts and not."""
    line = " ".join(f"line{i}" for i in range(30))
    rows = [(i, f"{line} " + " ".join(f"x{i}_{k}" for k in range(30))) for i in range(120)]
    for bounds in ({}, {"rows": 16}):
        found = rows_of(minhash.groups(documents(rows), **bounds))
        assert found == sorted(((i, 58, i, True) for i in range(120)), key=repr)


def test_a_chain_of_a_bucket_goes_on_as_a_star():
    """As pairs the 2,000 links of a chain took round after round to contract."""
    chain = [(i, i + 1) for i in range(1, 2000)]
    made = minhash._stars(np.arange(5000, 7002), chain)
    assert set(zip(made["a"].to_pylist(), made["b"].to_pylist())) == {(5001, 5000 + i) for i in range(2, 2001)}
    assert minhash._stars(np.arange(3), []).num_rows == 0
