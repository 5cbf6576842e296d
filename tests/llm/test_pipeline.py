"""The pipeline against its stages worked out by hand over the whole table."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from framelake.llm import cnn, pii
from test_near import plain_roots
from test_pii import PATTERNS, brute


def pieces_of(rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    return sorted(out, key=repr)


def check(found, rows):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == pieces_of(rows)
    held = defaultdict(list)
    for row in found:
        held[row.sequence_id].append((row.offset, row.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in found) // 2048) + 1


def by_hand(spark, docs, labels):
    """(doc_id, masked text) of the documents that are left."""
    net = cnn.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if net.score(r.text or "") >= 0.3]
    groups = plain_roots([text for _, text in rows])
    kept = {}
    for row, group in zip(rows, groups):
        kept[group] = min(row, kept.get(group, row), key=lambda r: (r[0] is None, r[0] or 0))
    return [(doc_id, pii.masked(text or "", pii.find_spans(text or ""))) for doc_id, text in kept.values()]


def test_stages_are_named_and_ordered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "personal_data", "packing"]


def test_the_table(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = by_hand(spark, docs, labels)
    check(corpus_pipeline.run(spark, sf).collect(), rows)
    left = {i: t for i, t in rows}
    for row in docs.collect():
        if row.doc_id in left:
            assert (left[row.doc_id] == row.text) or any(pii.find_spans(row.text).values())
            assert not any(brute(left[row.doc_id])[kind] for kind in PATTERNS)


@pytest.fixture
def folder(spark, tmp_path):
    """Documents with edge rows and an extra column, and labels for some."""
    good = ["The %s of the day is near us, and it was so for a long time in the town." % w for w in ("sea", "hill", "end", "man")]
    rows = [(i, f"{good[i % 4]} {i} {i * i} words {i + 7}", "x") for i in range(80)]
    rows += [(100 + i, f"a{i}$$$ b### c%%% d&&& {i}", "x") for i in range(40)]
    rows += [(200, None, "x"), (201, "", None), (3, rows[3][1], "x"), (3, rows[3][1], "x"), (None, rows[5][1], "x"), (300, good[0] + " to a@b.example.org", "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), x) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 100), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_edge_rows_and_columns(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    check(corpus_pipeline.run(spark, folder).collect(), by_hand(spark, docs, labels))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
