"""Phrases against counting in Python integers; filters by round trips."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import phrases
from framelake.llm.quotient import Filter, halves, pack, permute, unpack

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=100, top=2000):
    """rows: (lang, text)"""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            around = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(b >= a for b in around):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((lang, " ".join(p), a, left, right, n, score))
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(found[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def edge_rows():
    draw = random.Random(2)
    words = ["New", "york", "CITY", "of", "the", "É", "é", "naïve", "中文", "a-b", "\x00", "_"]
    rows = [(draw.choice(["en", "en", None, "de"]), draw.choice([" ", "\t", "  "]).join(draw.choices(words, k=draw.randint(0, 14)))) for _ in range(200)]
    rows += [("en", "new york city. Of the; new york city\nof the"), ("en", "in front of the big house " * 30), ("en", "the the the the the the the")]
    rows += [("fr", None), ("fr", ""), ("fr", ". , ;"), ("it", "solo"), ("en", "long words here " * 20_000), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"tokens": 50, "entries": 16}])
def test_collocations_equal_plain_counts(spark, bounds):
    rows = edge_rows()
    docs = spark.createDataFrame([(i, t, la, 7, "x") for i, (la, t) in enumerate(rows)], "doc_id int, text string, lang string, a int, `words.n` string")
    assert rows_of(phrases.collocations(docs, least=3, **bounds)) == plain(rows, 3)
    assert rows_of(phrases.collocations(docs, least=2, top=3, **bounds)) == plain(rows, 2, 3)


def test_empty_tables(documents):
    assert phrases.collocations(documents([])).count() == 0
    assert phrases.collocations(documents([(1, "too few of these"), (2, None)])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.data(), st.integers(1, 25), st.integers(0, 6))
def test_filters_return_what_they_count(data, width, bits):
    half = halves(width)
    bits = min(bits, half)
    items = data.draw(st.lists(st.lists(st.integers(1, 2**width - 1), min_size=3, max_size=5), max_size=40))
    padded = np.array([i + [0] * (5 - len(i)) for i in items], np.int64).reshape(-1, 5)
    assert (unpack(*pack(padded, width), width) == padded).all()
    found = Filter.of(*permute(*pack(padded, width), half), half, np.arange(1, len(items) + 1) * 200)
    counts = Counter()
    for own, part in found.ranges(bits):
        again = Filter.from_bytes(part.to_bytes(bits))
        assert (again.high == part.high).all() and (again.low == part.low).all() and (again.count == part.count).all()
        assert bits == 0 or (again.high >> np.uint64(half - bits) == own).all()
        counts.update({tuple(w): int(n) for w, n in zip(unpack(*again.items(), width).tolist(), again.count)})
    expected = Counter()
    for i, item in enumerate(padded.tolist()):
        expected[tuple(item)] += 200 * (i + 1)
    assert counts == expected


@settings(max_examples=60, deadline=None)
@given(st.data(), st.integers(4, 25), st.integers(0, 4))
def test_merged_filters_add_up(data, width, bits):
    pair = st.tuples(st.integers(1, 2**width - 1), st.integers(1, 9))
    shards = data.draw(st.lists(st.lists(pair, max_size=50), min_size=1, max_size=5))
    filters, expected = [], Counter()
    for shard in shards:
        a, b = (np.array([pair[i] for pair in shard], np.uint64) for i in (0, 1))
        filters.append(Filter.of(*permute(a, b, width), width))
        expected.update(shard)
        parts = [Filter.from_bytes(f.to_bytes(bits)) for _, f in filters[-1].ranges(bits)]
        assert sum(len(p) for p in parts) == len(set(shard))
    merged = Filter.merged(filters)
    high, low = merged.items()
    assert {(int(a), int(b)): int(n) for a, b, n in zip(high, low, merged.count)} == expected
    assert len(filters[0].within(merged)) == len(filters[0])
    assert len(merged.within(filters[0])) == len(filters[0])


def test_random_items_spread_over_ranges_and_stay_compact():
    numbers = np.arange(1, 40_001, dtype=np.uint64)
    found = Filter.of(*permute(numbers // 200 + 1, numbers % 200 + 1, 18), 18)
    sizes = [len(f) for _, f in found.ranges(5)]
    assert len(sizes) == 32 and max(sizes) < 1.2 * len(found) / 32
    assert sum(len(f.to_bytes(5)) for _, f in found.ranges(5)) < 7 * len(found)


def block_of(n, words, seed=3):
    places = np.random.default_rng(seed).integers(1, words + 1, n).astype(np.uint32)
    places[::17] = 0
    return places


def counted(places, n, known=None):
    found = Counter(tuple(places[i : i + n].tolist()) for i in range(len(places) - n + 1) if places[i : i + n].all())
    return Counter({p: a for p, a in found.items() if known is None or all(p[i : i + 2] in known for i in range(n - 1))})


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("length", [1, 2, 4, 120])
def test_items_across_slices_count_once(size, length):
    places, width = block_of(length, 3), 2
    filters = list(phrases.pair_filters(places, width, size))
    whole = Filter.merged(filters)
    pairs = counted(places, 2)
    assert dict(zip(zip(*(x.tolist() for x in whole.items())), whole.count.tolist())) == pairs
    frequent = whole.at_least(3)
    known = set(zip(*(x.tolist() for x in frequent.items())))
    longer = Filter.merged(list(phrases.phrase_filters(places, [frequent], width, size)))
    found = {tuple(x for x in w if x): a for w, a in zip(unpack(*longer.items(), width).tolist(), longer.count.tolist())}
    assert found == sum((counted(places, n, known) for n in (3, 4, 5)), Counter())


def test_counting_a_block_takes_little_beside_its_items():
    """Memory follows the slices and the different items, not the places of a block."""
    import tracemalloc

    import pyarrow as pa

    places, width, bits = block_of(1 << 21, 30), 5, 4
    pairs = Filter.merged(list(phrases.pair_filters(places, width))).to_bytes(0)
    columns = {"block": [7], "lang": ["en"], "places": [places.tobytes()], "filters": [[pairs]]}
    batch = pa.RecordBatch.from_pydict(columns)
    for run, rows, most in ((phrases._pairs(bits, width), batch.select(["block", "lang", "places"]), 60), (phrases._phrases(bits, width), batch, 250)):
        tracemalloc.start()
        made = sum(part.num_rows for part in run(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert made >= 1 << bits and peak < most, peak


def test_words_of_blocks_are_shuffled_once(spark):
    """The blocks' words go through one exchange; what is joined has a row for each frequent word, however many blocks hold it."""
    from framelake.llm import phrases

    rows = [(i, f"common pair of words and {i} rare{i % 7}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(20)
    counts = phrases.Counts(docs, 100, tokens=64)
    held = {(r.word, r.a) for r in counts.vocabulary.collect()}
    assert held == {(w, 400) for w in ("common", "pair", "of", "words", "and")}
    blocks = spark.read.parquet(*[f for f in _stored_folders(spark, "words")][-1:])
    assert blocks.count() == len(held)
    assert blocks.selectExpr("min(size(entries))").first()[0] > 20


def test_numbers_go_back_as_one_row_for_each_block():
    """However many words a task reads, a block gets one list from each batch, and no entry is lost."""
    import pyarrow as pa

    draw = random.Random(5)
    entries = [[{"block": b << 32, "local": 1000 * w + b} for b in sorted(draw.sample(range(6), draw.randint(0, 6)))] for w in range(300)]
    kind = pa.list_(pa.struct([("block", pa.int64()), ("local", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1, 301), pa.int32()), pa.array(entries, kind)], ["number", "entries"])
    for rows in (batch, batch.slice(7, 90), batch.slice(0, 0)):
        (out,) = phrases._by_block(iter([rows]))
        assert out.num_rows <= 6
        found = {(r["block"], at, n) for r in out.to_pylist() for at, n in zip(r["local"], r["number"], strict=True)}
        assert found == {(e["block"], e["local"], r["number"]) for r in rows.to_pylist() for e in r["entries"]}


def test_places_are_dealt_once(spark, monkeypatch):
    """The filters that come back go to the places' buckets, whether or not they are small enough to be broadcast."""
    from framelake.llm import phrases

    plans = []
    merge = phrases.Counts._merge

    def watched(filters, *rest):
        plans.append(filters._jdf.queryExecution().executedPlan().toString())
        return merge(filters, *rest)

    monkeypatch.setattr(phrases.Counts, "_merge", staticmethod(watched))
    rows = [(i, f"common pair of words and {i} rare{i % 7}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(20)
    tables = spark.catalog.listTables()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = phrases.Counts(docs, 100, tokens=64)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[1].count("SortMergeJoin") == plans[1].count("Exchange hashpartitioning") == 1
    assert spark.catalog.listTables() == tables
    assert max(len(r.ids) for r in counts.phrases.collect()) == 5


def _stored_folders(spark, name):
    import glob
    import os

    from framelake.llm.scratch import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    return sorted(glob.glob(f"{folder}/{spark.sparkContext.applicationId}/*{name}*"), key=os.path.getmtime)
