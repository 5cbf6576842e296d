"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, cnn, divergence, html_text, minhash, packing, phrases, pii, rollups, simhash, sketches, topk, warc
from .registry import ORACLES, QUERIES, query, table
from .scratch import new_path, stored

__all__ = ["ORACLES", "QUERIES"]


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id")


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cnn.score(docs, cnn.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks)


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op6_sketches")
def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_versions(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json, as ranks
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), ranks, added=added)


@query("op8_rollups")
def op8_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents loaded under two versions, one recounted, one moved to a new version by a batch that is sent twice."""
    versions = ("byte_bpe_50k", "byte_bpe_multi_50k")
    files = {v: public_tokenizers.path(f"{v}.tiktoken") for v in versions}
    counts = stored(rollups.token_counts(table(spark, sf_dir, "documents"), files), "counts")
    old, new = versions
    store = rollups.RollupStore(spark, new_path(spark, "rollups"))
    store.commit("load-bytes", rollups.changes(counts, "utf8", "insert", "chars"))
    store.commit("load-tokens", rollups.changes(counts, old, "insert", old))
    store.commit("recount-bytes", rollups.changes(counts, "utf8", "revise", "bytes", "chars"))
    upgrade = rollups.changes(counts, old, "delete", None, old).unionByName(rollups.changes(counts, new, "insert", new))
    store.commit("upgrade", upgrade)
    store.compact()
    store.commit("upgrade", upgrade)
    return store.totals()


@query("op9_topk")
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


@query("op10_html")
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op13_minhash")
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


@query("op11_phrases", phrases.SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_divergence", divergence.SQL)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
