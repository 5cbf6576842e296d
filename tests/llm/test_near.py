"""Near copies against the Jaccard similarity of all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from framelake.llm import near, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(texts):
    """Smallest position that each text is connected to, over all pairs."""
    sets = [plain_set(t) for t in texts]
    low = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and Fraction(len(a & b), len(a | b)) >= Fraction(4, 5)):
                x, y = low[i], low[j]
                low = [min(x, y) if v in (x, y) else v for v in low]
    return low


def family(draw, size, copies, edits):
    words = [f"w{draw.randrange(3000)}" for _ in range(size)]
    for _ in range(copies):
        own = list(words)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(size)] = f"e{draw.randrange(10**6)}"
        yield " ".join(own)


def texts_with_edges():
    draw = random.Random(4)
    line = " ".join(f"line{i}" for i in range(12))
    texts = [t for size, edits in ((40, 2), (90, 4), (300, 9)) for _ in range(4) for t in family(draw, size, 9, edits)]
    texts += [f"{line} " + " ".join(f"x{draw.randrange(10**6)}" for _ in range(6)) for _ in range(60)]
    texts += [None, "", " \n", "a b", "A  b", "a b c", "one two three four five", "one two three four five six"]
    # 9 shingles, and one more: 9/10; 4 and one more: exactly 4/5; 3 and one more: 3/4
    texts += [" ".join(f"{k}{i}" for i in range(n + more)) for k, n in (("p", 13), ("q", 8), ("r", 7)) for more in (0, 1)]
    return texts


@pytest.mark.parametrize("bounds", [{}, {"rows": 4}, {"hashes": 300}])
def test_groups_equal_all_pairs(documents, bounds):
    texts = texts_with_edges()
    found = {r.doc_id: r.root for r in near.groups(documents(list(enumerate(texts))), **bounds).collect()}
    low = plain_roots(texts)
    roots = [found[i] for i in range(len(texts))]
    assert [roots.index(r) for r in roots] == low


def test_fingerprints_follow_the_majority_of_a_set():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 100_000):
        found = np.unique(draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        ones = [sum(int(h) >> bit & 1 for h in found[:101].tolist()) for bit in range(64)]
        expected = sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(found[:101]))
        assert near.fingerprint(found[:101]) & (2**64 - 1) == expected
    whole = np.array([near.fingerprint(found)]).view(np.uint64)[0]
    assert int(whole) & 1 == 1  # all hashes are odd


def test_extra_columns_and_repeats_stay_as_they_are(spark):
    text = "one two three four five six seven"
    rows = [(None, text, 1, "x"), (4, text, 2, "y"), (4, text, 2, "y"), (4, text, 3, "z"), (9, None, 5, "x"), (8, "", 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c1 int, `a.b` string")
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0], r[1]) for r in kept.collect()) == [(4, text), (8, "")]


def test_the_stage_drops_near_copies_that_three_bits_miss(spark, documents):
    draw = random.Random(8)
    texts = [t for _ in range(20) for t in family(draw, 200, 2, 2)]
    kept = corpus_pipeline.near_copies(spark, documents(list(enumerate(texts))), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(plain_roots(texts)))
    assert len(kept) == 20 < simhash.deduplicated(documents(list(enumerate(texts)))).count()


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    low = plain_roots([t for _, t in rows])
    assert sorted(r.doc_id for r in near.deduplicated(docs).collect()) == sorted({rows[i][0] for i in low})
    assert near.deduplicated(docs.limit(0)).count() == 0
