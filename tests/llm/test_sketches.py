"""Sketches against the sets of paragraphs, and the edited texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from framelake.llm import sketches

PARAGRAPH = r"[^\r\n]{1,80}[^\r\n.!?]{0,160}[.!?]*"


def pieces(text):
    return {p.strip(" ") for p in re.findall(PARAGRAPH, text)} - {""}


def likeness(a, b):
    union = pieces(a) | pieces(b)
    return len(pieces(a) & pieces(b)) / len(union) if union else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (doc_id, text), (_, follow) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follow[:cut]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(text, edited), 9), round(likeness(text, follow), 9)))
    return sorted(out, key=repr)


def found(frame):
    rows = sketches.compare_versions(frame).collect()
    return rows, sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=repr)


def sentence(draw):
    return " ".join(draw.choice(["red", "blue", "é", "😀", "many"]) + str(draw.randint(0, 99)) for _ in range(draw.randint(1, 30))) + "."


def test_rows(documents, spark):
    draw = random.Random(3)
    body = " ".join(sentence(draw) for _ in range(900)) + "\n" + "x" * 5000
    rows = [(1, None), (2, ""), (3, "abc"), (5, body), (9, body), (9, body), (4, "a. b! c?\r\n\r\n d"), (None, "no id"), (-7, "first")]
    rows += [(100 + i, "\n".join(sentence(draw) for _ in range(draw.randint(1, 40)))) for i in range(60)]
    full, plain = found(documents(rows).withColumn("range", F.lit("x")).withColumn("row", F.lit(1)))
    assert plain == expected(rows)
    prints = {r.fingerprint for r in full if r.doc_id in (5, 9)}
    assert len(prints) == 1 and len({r.fingerprint for r in full}) > 55


def test_one_document_and_none(documents):
    assert found(documents([(1, "abcdefgh. ij")]))[1] == expected([(1, "abcdefgh. ij")])
    assert found(documents([]))[1] == []


@pytest.mark.parametrize("cells", [1, 3, 10])
def test_differences_are_recovered_at_any_size(spark, cells):
    draw = random.Random(cells)
    rows = []
    for _ in range(120):
        common = [draw.getrandbits(62) for _ in range(draw.randint(0, 40))]
        rows.append(([*common, *(draw.getrandbits(62) for _ in range(draw.randint(0, 25)))], [*common, *(-draw.getrandbits(62) for _ in range(draw.randint(0, 25)))]))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = frame.select(
        "a",
        "b",
        sketches.difference_size(F.col("a"), F.col("b"), cells).alias("size"),
        sketches.peeled(sketches._minus(sketches.sketch(F.col("a"), 40), sketches.sketch(F.col("b"), 40)), 40).alias("peeled"),
    ).collect()
    for row in got:
        size = len(set(row.a) ^ set(row.b))
        assert row.size == size and row.peeled in (size, None)
    assert sum(row.peeled is not None for row in got) > 110


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs)[1] == expected([(r.doc_id, r.text) for r in docs.collect()])
