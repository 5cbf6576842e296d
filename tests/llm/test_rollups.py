"""Totals against sums over the rows that are left, with batches sent again."""

import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from __spark_entry__ import queries
from framelake.llm import rollups
from framelake.llm.rollups import RollupStore

SCHEMA = "source string, lang string, tokenizer string, change string, tokens long, old_tokens long"


@pytest.fixture
def store(spark, tmp_path):
    return RollupStore(spark, f"file://{tmp_path}/store")


def totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def test_inserts_deletes_and_revisions(spark, store):
    first = [("a", "en", "t1", "insert", 10, None)] * 3 + [(None, "en", "t1", "insert", None, None), ("b", None, "t1", "insert", 4, None)]
    second = [("a", "en", "t1", "delete", None, 10), ("a", "en", "t1", "revise", 25, 10), ("b", None, "t1", "delete", None, 4)]
    assert totals(store) == {}
    assert store.commit("one", spark.createDataFrame(first, SCHEMA))
    assert totals(store) == {("a", "en", "t1"): (3, 30), (None, "en", "t1"): (1, 0), ("b", None, "t1"): (1, 4)}
    assert store.commit("two", spark.createDataFrame(second, SCHEMA))
    expected = {("a", "en", "t1"): (2, 35), (None, "en", "t1"): (1, 0)}
    assert totals(store) == expected
    assert not store.commit("two", spark.createDataFrame(second, SCHEMA))
    store.compact()
    assert totals(store) == expected
    assert not store.commit("one", spark.createDataFrame(first, SCHEMA))
    assert store.commit("empty", spark.createDataFrame([], SCHEMA))
    store.compact()
    assert store.commit("three", spark.createDataFrame(first[:1], SCHEMA))
    assert totals(store) == expected | {("a", "en", "t1"): (3, 45)}


def test_two_writers_of_one_batch(spark, store, monkeypatch):
    rows = spark.createDataFrame([("a", "en", "t1", "insert", 7, None)], SCHEMA)
    other = RollupStore(spark, store.path)
    monkeypatch.setattr(other, "committed", lambda batch: False)  # both have looked before either finished
    assert store.commit("same", rows) and not other.commit("same", rows)
    assert totals(store) == {("a", "en", "t1"): (1, 7)}


def test_bad_input_fails_and_leaves_nothing(spark, store):
    with pytest.raises(ValueError):
        store.commit("../x", spark.createDataFrame([], SCHEMA))
    with pytest.raises(Exception, match="unknown change"):
        store.commit("bad", spark.createDataFrame([("a", "en", "t1", "upsert", 1, 1)], SCHEMA))
    assert totals(store) == {} and not store.committed("bad")


def test_counts_of_edge_rows(spark, documents):
    files = {"v": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (4, "é" * 50_000)]
    found = rollups.token_counts(documents(rows).withColumnRenamed("n_chars", "chars"), files)
    assert sorted((r.chars, r.bytes, r.v > 0) for r in found.collect()) == [
        (0, 0, False), (0, 0, False), (9, 9, True), (9, 9, True), (50_000, 100_000, True)]
    assert rollups.token_counts(documents([]), files).count() == 0


def test_query_equals_sums_over_the_documents(spark, sf):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected: Counter = Counter()
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for version, count in (("utf8", len(row.text.encode())), ("byte_bpe_multi_50k", len(library.encode_ordinary(row.text)))):
            expected[row.source, row.lang, version, "docs"] += 1
            expected[row.source, row.lang, version, "tokens"] += count
    found: Counter = Counter()
    for row in queries()["op8_rollups"](spark, sf).collect():
        found[row.source, row.lang, row.tokenizer, "docs"] = row.n_docs
        found[row.source, row.lang, row.tokenizer, "tokens"] = row.n_tokens
    assert found == expected
