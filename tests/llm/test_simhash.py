"""Fingerprints by definition, groups against all pairs, and the index alone."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import components as contraction
from framelake.llm import simhash
from framelake.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_groups(codes):
    """Smallest position reachable from each, over all pairs."""
    low = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(codes):
            best = min(low[j] for j, b in enumerate(codes) if (a ^ b).bit_count() <= 3)
            if best < low[i]:
                low[i], changed = best, True
    return low


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB cÉ\n\x1c \t", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(5000))
    monkeypatch.setattr(simhash, "COUNTED", 100)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(seed, centres, each, flips):
    draw = random.Random(seed)
    codes = []
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(each):
            code = centre
            for _ in range(draw.randint(0, flips)):
                code ^= 1 << draw.randrange(64)
            codes.append(code)
    return list(dict.fromkeys(codes))


@pytest.mark.parametrize("fan,pairs", [(2, 8), (8, 16_384)])
def test_index_connects_what_all_pairs_connect(monkeypatch, fan, pairs):
    monkeypatch.setattr(simhash, "FAN", fan)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    for seed in range(8):
        codes = clustered(seed, 12, 15, 4) + [0, 1, 2**64 - 1]
        keys = [seed % 2 * (i % 3) for i in range(len(codes))]
        order = sorted(range(len(codes)), key=lambda i: (keys[i], simhash.gray_rank(np.array([codes[i]], np.uint64))[0]))
        codes, keys = [codes[i] for i in order], [keys[i] for i in order]
        links = list(simhash.GrayIndex(np.array(codes, np.uint64), np.array(keys)).links())
        assert all((codes[a] ^ codes[b]).bit_count() <= 3 and keys[a] == keys[b] for a, b in links)
        for key in set(keys):
            own = [i for i, k in enumerate(keys) if k == key]
            low = {i: i for i in own}
            for _ in own:
                for a, b in links:
                    if keys[a] == key:
                        low[a] = low[b] = min(low[a], low[b])
            assert [own.index(low[i]) for i in own] == plain_groups([codes[i] for i in own])


def test_masks_leave_one_part_untouched():
    for mask in (0, 0xFFFF, 0xFFFF00000FFF):
        children = simhash.child_masks(mask)
        assert len(children) == 4
        parts = [c & ~mask for c in children]
        assert sum(parts) == mask ^ (1 << 64) - 1 and all(c & mask == mask for c in children)


@pytest.mark.parametrize("node", [4, 2048])
def test_links_with_nodes_split_to_the_last_layer(spark, node):
    codes = clustered(3, 6, 40, 5)
    frame = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    found = {r.vertex: r.root for r in components(simhash.links(frame, node)).collect()}
    roots = [found.get(simhash._signed(c), simhash._signed(c)) for c in codes]
    low = plain_groups(codes)
    assert [roots.index(r) for r in roots] == [low.index(v) for v in low]


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 80)]
    odd = [(5, 4), (5, 5), (None, 3), (2000, 2000), (3000, 3001), (3001, 3000)]
    frame = spark.createDataFrame(chain + hub + odd, "a long, b long")
    found = {r.vertex: r.root for r in components(frame).collect()}
    assert set(found) == {*range(61), *range(1000, 1080), 3000, 3001}
    assert len({found[i] for i in range(61)}) == len({found[i] for i in range(1000, 1080)}) == 1
    assert len(set(found.values())) == 3
    assert components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("hubs, most", [(1, 2), (40, 5)])
def test_hubs_take_few_rounds(spark, monkeypatch, hubs, most):
    """New ranks in each round took 11 and 8 rounds for these."""
    names = []
    real = contraction.stored
    monkeypatch.setattr(contraction, "stored", lambda df, name: names.append(name) or real(df, name))
    draw = random.Random(3)
    links = [(-1 - h, v) for h in range(hubs) for v in (range(3000) if hubs == 1 else draw.sample(range(3000), 150))]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len({r.root for r in found}) == 1 and len(found) == len({v for link in links for v in link})
    assert names.count("moves") <= most


WORDS = [f"w{i}" for i in range(400)]


def edge_rows():
    draw = random.Random(2)
    base = " ".join(draw.choice(WORDS) for _ in range(300))
    rows = [(i, base if i % 3 else base + f" x{i}") for i in range(10, 40)]
    rows += [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 40)))) for i in range(100, 140)]
    rows += [(1, None), (2, ""), (3, " \n"), (12, base), (12, base), (None, base), (7, "zz"), (7, "other words here now")]
    return rows


def test_groups_equal_all_pairs(documents):
    rows = edge_rows()
    codes = [plain_fingerprint(t) for _, t in rows]
    low = plain_groups(codes)
    smallest = {}
    for (doc_id, _), group in zip(rows, low):
        if doc_id is not None:
            smallest[group] = min(doc_id, smallest.get(group, doc_id))
    expected = sorted(((d, f"{c:016x}", smallest.get(g)) for (d, _), c, g in zip(rows, codes, low)), key=repr)
    found = simhash.groups(documents(rows))
    found = found.select("doc_id", simhash.hex_digits(found["fp"]), "component_id").collect()
    assert sorted((tuple(r) for r in found), key=repr) == expected
    kept = simhash.deduplicated(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest.values())


def test_empty_table(documents):
    assert simhash.groups(documents([])).count() == 0
    assert simhash.deduplicated(documents([])).count() == 0
    assert simhash.deduplicated(documents([(None, "a b"), (None, "a b")])).count() == 1
