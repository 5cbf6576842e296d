"""The audit worked out in Python integers, at several sizes of the cube's blocks."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from framelake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    """rows: (lang, source, text)"""
    counts, documents, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        sources[lang].add(source)
        counts[lang, source].update(found)
        documents[lang].update(set(found))
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= 3)

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        whole = shares(sum((counts[lang, s] for s in names), Counter()))
        own = {s: shares(counts[lang, s]) for s in names}
        for s in names:
            pair = [(sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in names - {s}]
            term = [((own[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def edge_rows():
    draw = random.Random(3)
    words = ["Alpha", "beta's", "GAMMA-ray", "d1e2f", "É", "é", "ßß", "naïve", "中文", "_x_", "zz", "\U0001f600"]
    rows = []
    for i in range(150):
        lang, source = draw.choice(["en", "en", "de", None, ""]), draw.choice(["hot", "hot", "hot", "a", "B", "é", None, ""])
        rows.append((lang, source, draw.choice([" ", ",", "\n", "9"]).join(draw.choices(words, k=draw.randint(0, 12)))))
    rows += [("fr", "only", "a b c"), ("fr", "other", "a b"), ("it", "x", None), ("it", "y", ""), ("it", "x", "12 34")]
    rows += [("en", "void", "1 2 3"), ("en", "long", "word other " * 40_000), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"group_block": 1, "term_block": 1}, {"group_block": 2, "term_block": 3}])
def test_audit_equals_plain_integers(spark, bounds):
    rows = edge_rows()
    docs = spark.createDataFrame([(s, i, t, la, 1, "z") for i, (la, s, t) in enumerate(rows)], "source string, doc_id int, text string, lang string, value int, `rank.item` string")
    assert rows_of(divergence.audit(docs, **bounds)) == plain(rows)
    assert rows_of(divergence.audit(docs, top=2, **bounds)) == plain(rows, 2)


def test_empty_table_and_flushes(documents, monkeypatch):
    assert divergence.audit(documents([])).count() == 0
    monkeypatch.setattr(divergence, "HELD", 1)
    rows = [(i, "one two three four one") for i in range(9)]
    assert rows_of(divergence.audit(documents(rows))) == plain([("en", "s", t) for _, t in rows])


def test_shares_are_exact_for_large_counts():
    draw = random.Random(1)
    for _ in range(300):
        total = draw.randrange(1, 9 * 10**15)
        count = draw.randrange(total)
        assert divergence.share(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total
