"""Anchor expansion against the plain patterns."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(part) <= 255 for part in text.split("."))
    if kind == "card":
        sums = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(sums) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=2000, deadline=None)
@given(st.one_of(*(st.text(alphabet=a, max_size=60) for a in ("01.+@a- ", "0 1-9", "+12 ().3-", "ab@.-c", "12.3 4é"))))
def test_base_kinds_equal_the_patterns(text):
    found = pii.find_spans(text)
    assert {k: found[k] for k in PATTERNS} == brute(text)


def test_added_kinds():
    text = 'IBAN: DE89 3704 0044 0532 0130 00 and token = "9233a8ecf7" see ftp://joe:pw1@host.example/x, or http://example.org'
    found = pii.find_spans(text)
    assert [text[a:b] for a, b in found["account"]] == ["DE89 3704 0044 0532 0130 00", "9233a8ecf7"]
    assert [text[a:b] for a, b in found["url"]] == ["ftp://joe:pw1@host.example/x"]
    assert pii.find_spans("a token of thanks, account 12, the secret of 1234567")["account"] == []


ROWS = [
    (1, None),
    (2, ""),
    (3, "é mail a.b@c.example.org now, 10.0.0.1 or 300.1.1.1"),
    (4, "card 4111 1111 1111 1111 phone +1 (017) 555-7713"),
    (4, "card 4111 1111 1111 1111 phone +1 (017) 555-7713"),
    (5, "@" * 50_000 + "1.2.3.4" * 20_000 + "+1" * 50_000 + "5 5-5" * 20_000 + "token=" * 20_000),
    (None, "nobody@nowhere.example"),
]


def test_detect_on_edge_rows(documents):
    found = {(r.doc_id, r.base_sha256) for r in pii.detect(documents(ROWS)).collect()}
    for doc_id, text in ROWS:
        spans = brute(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k])
        assert (doc_id, hashlib.sha256(listed.encode()).hexdigest()) in found
    assert pii.detect(documents([])).count() == 0


def test_redact_keeps_columns_and_clean_texts(spark):
    frame = spark.createDataFrame(
        [(1, "x", "to a@b.cd!", 10), (2, "y", "clean text 12", 13), (3, "z", None, 0), (4, "", "", 0)],
        "doc_id long, rest string, text string, n_chars long",
    )
    found = pii.redact(frame)
    assert found.schema == frame.schema
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "x", "to [EMAIL]!", 11),
        (2, "y", "clean text 12", 13),
        (3, "z", None, 0),
        (4, "", "", 0),
    ]


def test_every_document_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = pii.detect(docs).collect()
    assert len(found) == len(texts)
    for row in found:
        spans = brute(texts[row.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k])
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(len(spans[k]) for k in PATTERNS)


def test_other_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "to a@b.example.org", "x", 2.0, "r")], "doc_id long, text string, `a.b` string, none double, rest string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    row = out.first()
    assert (row[0], row[2], row[3], row[4]) == (1, "x", 2.0, "r") and "@" not in row[1]
