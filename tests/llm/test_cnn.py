"""The network: gradients, whole texts, held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from framelake.llm import cnn

GOOD = [f"The {a} of the {b} is near {c}, and it was so." for a in ("sea", "hill", "town") for b in ("man", "day") for c in ("us", "it")]
JUNK = [f"{a}$$$ {b}### {a}%%% {b}&&&" for a in ("sea", "hill", "town") for b in ("man", "day", "end", "way")]


def test_gradients_equal_finite_differences():
    net = cnn.Network.initial(3)
    net.weights = {k: v.astype("f8") for k, v in net.weights.items()}
    texts = [[np.frombuffer(r, np.uint8) for r in cnn.training_runs(t)] for t in ("ab" * 300 + "xyz", "short", "q" * 900)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        scores = [cnn.Network.score(net, t) for t in ("ab" * 300 + "xyz", "short", "q" * 900)]
        return -sum(np.log(s if y else 1 - s) for s, y in zip(scores, labels)) / 3

    # texts of a single run, which training and scoring cut alike
    grads = cnn._gradients(net, texts, labels)
    draw = np.random.default_rng(0)
    for name, weight in net.weights.items():
        for _ in range(6):
            at = tuple(draw.integers(0, s) for s in weight.shape)
            if name == "embedding":
                at = (ord("ab"[at[0] % 2]), at[1])
            kept, step = weight[at], 1e-5
            weight[at] = kept + step
            up = loss()
            weight[at] = kept - step
            down = loss()
            weight[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-4)


def test_whole_text_counts_and_segments_change_nothing(monkeypatch):
    net = cnn.Network.initial(5)
    net.weights["max_weights"][:] = 0.3
    texts = ["", "a", "word " * 500, "x" * 128, "y" * 129, "é" * 3000]
    plain = [net.score(t) for t in texts]
    monkeypatch.setattr(cnn, "SEGMENT", 2)
    assert [net.score(t) for t in texts] == pytest.approx(plain, abs=1e-6)
    assert net.score("word " * 5000) != net.score("word " * 5000 + "#$%&" * 50)
    assert cnn.Network.unpack(net.pack()).score(texts[2]) == net.score(texts[2])


@pytest.fixture(scope="module")
def trained(spark):
    texts = (GOOD + JUNK) * 12
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(t in GOOD), 0) for i, t in enumerate(texts)] + [(0, None, 0), (None, 1, 0), (1, 7, 0), (10**9, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    return docs, labels, cnn.fit(docs, labels)


def test_held_out_accuracy_and_columns(trained):
    docs, labels, net = trained
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = cnn.score(docs, net).collect()
    assert len(found) == len(texts)
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3)
        assert row.predicted == int(texts[row.doc_id] in GOOD)
    kept = cnn.accepted(docs.selectExpr("doc_id", "text", "'x' as score", "1 as runs"), net)
    assert kept.columns == ["doc_id", "text", "score", "runs"]
    assert {r.text for r in kept.collect()} == set(GOOD)


def test_held_out_labels_are_never_read(spark, trained):
    docs, labels, net = trained
    turned = labels.withColumn("quality", (labels["quality"] + 1) % 2).filter(cnn.held_out(labels["doc_id"]))
    other = cnn.fit(docs, labels.filter(~cnn.held_out(labels["doc_id"])).union(turned))
    assert other.pack() == net.pack()


def test_edge_rows_and_missing_labels(spark, documents):
    rows = [(1, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000), (None, "text")]
    docs = documents(rows)
    net = cnn.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len({r.score for r in cnn.score(docs, net).collect()}) == 1
    assert cnn.score(docs, net).count() == cnn.accepted(docs, net).count() == 5
    assert cnn.score(documents([]), net).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables missing")
def test_held_out_accuracy_on_the_table(spark):
    """The smallest table with enough held-out labels (70) to measure."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = cnn.score(docs, cnn.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.93 * len(found)
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)
