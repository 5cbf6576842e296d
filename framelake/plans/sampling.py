"""Queries over chunks, shards, batches, padding and epochs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.integers import div
from ..operators import sampling as ops
from ..operators.numbering import dense_index, int_bucket
from ..session import ensure_checkpoint_dir
from ..sources import tar_shards
from . import views as v
from .registry import query

CHUNK = 3
KEYED = {
    "keyed": "SELECT *, dataset_index || '-' || episode_index AS key FROM mixed_frames",
    "chunked": f"""SELECT *, frame_index // {CHUNK} AS chunk, key || '_' || (frame_index // {CHUNK}) AS chunk_key
      FROM keyed WHERE frame_index // {CHUNK} < length // {CHUNK}""",
}


def keyed_frames(spark, sf):
    return v.mixed_frames(spark, sf).withColumn("key", F.concat_ws("-", "dataset_index", "episode_index"))


def numbered_documents(spark, sf):
    return dense_index(v.table(spark, sf, "documents").select("doc_id"), ["doc_id"], int_bucket("doc_id"))


def document_count(spark, sf):
    return v.table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()


NUMBERED = "numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents)"


@query(
    "split_to_chunks",
    v.with_views("mixed_frames", extra=KEYED)
    + f"SELECT chunk_key, chunk, frame_index, frame_index % {CHUNK} AS frame_in_chunk, absolute_index FROM chunked",
)
def split_to_chunks(spark, sf):
    chunks = ops.split_to_chunks(keyed_frames(spark, sf), CHUNK)
    return chunks.select("chunk_key", "chunk", "frame_index", "frame_in_chunk", "absolute_index")


@query(
    "one_chunk_per_video",
    v.with_views("mixed_frames", extra=KEYED)
    + f"""SELECT chunk_key, frame_index FROM chunked
    WHERE chunk = floor({v.uniform_sql(9, 'key')} * (length // {CHUNK}))""",
)
def one_chunk_per_video(spark, sf):
    chunks = ops.split_to_chunks(keyed_frames(spark, sf), CHUNK)
    return ops.one_chunk_per_video(chunks, "key", CHUNK, seed=9).select("chunk_key", "frame_index")


@query(
    "explode_frames",
    v.with_views("mixed_episodes")
    + "SELECT dataset_index, episode_index, unnest(range(length)) AS frame_index FROM mixed_episodes",
)
def explode_frames(spark, sf):
    return ops.explode_frames(v.mixed_episodes(spark, sf)).select("dataset_index", "episode_index", "frame_index")


@query(
    "expected_sample_counts",
    v.with_views("patches", extra={"videos": "SELECT video, max(frame) + 1 AS size FROM patches GROUP BY video"})
    + """SELECT count(*) AS n_videos, CAST(count(*) * 5 // 2 AS BIGINT) AS expected_chunks, CAST(count(*) * 5 AS BIGINT) AS expected_frames,
    count(*) AS expected_one_chunk, CAST(sum(size // 2) AS BIGINT) AS actual_chunks, CAST(sum(size) AS BIGINT) AS actual_frames FROM videos""",
)
def expected_sample_counts(spark, sf):
    """The declared count divides frames of all videos; whole chunks per video can be fewer."""
    videos = v.patches(spark, sf).groupBy("video").agg((F.max("frame") + 1).alias("size"))
    n = F.count(F.lit(1))
    return videos.agg(
        n.alias("n_videos"),
        ops.expected_sample_counts(n, v.FRAMES, 2).alias("expected_chunks"),
        ops.expected_sample_counts(n, v.FRAMES, 1).alias("expected_frames"),
        ops.expected_sample_counts(n, v.FRAMES, 2, one_chunk=True).alias("expected_one_chunk"),
        F.sum(div("size", 2)).alias("actual_chunks"),
        F.sum("size").alias("actual_frames"),
    )


@query(
    "round_robin_shards",
    f"""WITH {NUMBERED}, sized AS (SELECT *, count(*) OVER () AS n FROM numbered)
    SELECT doc_id, row_id % 7 AS rank, row_id // 7 AS position, (n - 1 - row_id % 7) // 7 + 1 AS rank_length FROM sized""",
)
def round_robin_shards(spark, sf):
    dealt = ops.round_robin_shards(numbered_documents(spark, sf), 7)
    return dealt.select(
        "doc_id",
        "rank",
        "position",
        ops.shard_length(document_count(spark, sf), F.col("rank"), 7).alias("rank_length"),
    )


@query(
    "assign_batches",
    f"""WITH {NUMBERED}, sized AS (SELECT *, count(*) OVER () AS n FROM numbered)
    SELECT doc_id, row_id // 48 AS batch, row_id % 48 AS slot, n // 48 AS full_batches, CAST(ceil(n / 48) AS BIGINT) AS all_batches
    FROM sized WHERE row_id // 48 < n // 48""",
)
def assign_batches(spark, sf):
    n = document_count(spark, sf)
    batches = ops.assign_batches(numbered_documents(spark, sf), 48, n, drop_last=True)
    return batches.select(
        "doc_id",
        "batch",
        "slot",
        ops.batches_per_epoch(n, 48).alias("full_batches"),
        ops.batches_per_epoch(n, 48, partial=True).alias("all_batches"),
    )


@query(
    "epoch_repeat",
    """WITH rows AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id, count(*) OVER () AS n FROM labels),
    goal AS (SELECT count(*) * 2 + 5 AS m FROM documents)
    SELECT doc_id, CAST(row_id + k * n AS BIGINT) AS position FROM (SELECT *, unnest(range(m // n + 1)) AS k FROM rows, goal) WHERE row_id + k * n < m""",
)
def epoch_repeat(spark, sf):
    """Labels cycle until an epoch of twice the documents (and five more) is full."""
    labels = v.table(spark, sf, "labels").select("doc_id")
    numbered = dense_index(labels, ["doc_id"], int_bucket("doc_id"))
    total = labels.agg(F.count(F.lit(1))).scalar()
    return ops.epoch_repeat(numbered, total, document_count(spark, sf) * 2 + 5).select("doc_id", "position")


@query(
    "shard_assign_maxcount",
    f"""WITH {NUMBERED} SELECT doc_id, row_id // 32 AS shard_id, row_id % 32 AS shard_pos,
    printf('docs-%06d.tar', row_id // 32) AS shard_file FROM numbered""",
)
def shard_assign_maxcount(spark, sf):
    shards = ops.assign_shards(numbered_documents(spark, sf), 32, "docs-%06d.tar")
    return shards.select("doc_id", "shard_id", "shard_pos", "shard_file")


@query(
    "resampled_shards",
    f"""WITH {NUMBERED}, n AS (SELECT CAST(ceil(count(*) / 32) AS BIGINT) AS n_shards FROM documents),
    draws AS (SELECT event_id AS draw, ('0x' || substr(md5('17:' || event_id), 1, 13))::BIGINT % n_shards AS shard_id FROM events, n)
    SELECT shard_id, count(*) AS n_draws, (SELECT count(*) FROM numbered WHERE row_id // 32 = shard_id) AS shard_rows
    FROM draws GROUP BY shard_id""",
)
def resampled_shards(spark, sf):
    """Shards drawn with replacement, one draw per event."""
    n_shards = v.table(spark, sf, "documents").agg(F.ceil(F.count(F.lit(1)) / 32)).scalar()
    draws = ops.resampled_shards(
        v.table(spark, sf, "events").select(F.col("event_id").alias("draw")), n_shards, seed=17
    )
    sizes = (
        ops.assign_shards(numbered_documents(spark, sf), 32)
        .groupBy("shard_id")
        .agg(F.count(F.lit(1)).alias("shard_rows"))
    )
    return draws.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_draws")).join(sizes, "shard_id")


@query(
    "shard_balance",
    """WITH s AS (SELECT lang AS split, source, count(*) AS n FROM documents GROUP BY ALL),
    t AS (SELECT split, count(*) AS n_shards, CAST(sum(n) AS BIGINT) AS n_samples FROM s GROUP BY 1)
    SELECT split, n_shards, n_samples,
    CAST(ceil(ceil(n_shards / 2) / 2) * ceil(n_samples / n_shards) AS BIGINT) AS max_per_worker,
    n_shards // 2 >= 1 AS enough_shards, n_shards // 2 >= 2 AS workers_fit FROM t""",
)
def shard_balance(spark, sf):
    """Languages as splits, sources as shards, two nodes with two workers."""
    sizes = v.table(spark, sf, "documents").groupBy(F.col("lang").alias("split"), "source").agg(
        F.count(F.lit(1)).alias("n_samples")
    )
    return ops.shard_balance(sizes, n_nodes=2, n_workers=2)


@query(
    "exactly_once_check",
    """SELECT 'documents' AS source, count(*) AS n_keys, count(DISTINCT doc_id) AS n_unique, max(doc_id) + 1 AS n_expected,
      count(*) = count(DISTINCT doc_id) AND count(DISTINCT doc_id) = max(doc_id) + 1 AS exactly_once FROM documents
    UNION ALL SELECT 'lineitem', count(*), count(DISTINCT k), (SELECT count(*) FROM lineitem), count(*) = count(DISTINCT k)
    FROM (SELECT l_orderkey || '-' || l_linenumber AS k FROM lineitem)""",
)
def exactly_once_check(spark, sf):
    docs = v.table(spark, sf, "documents")
    lines = v.table(spark, sf, "lineitem")
    first = ops.exactly_once_check(
        docs.select(F.col("doc_id").cast("string").alias("key")), "key", docs.agg(F.max("doc_id") + 1).scalar()
    )
    second = ops.exactly_once_check(
        lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")),
        "key",
        lines.agg(F.count(F.lit(1))).scalar(),
    )
    return first.withColumn("source", F.lit("documents")).unionByName(
        second.withColumn("source", F.lit("lineitem"))
    )


@query(
    "topk_per_row",
    """SELECT user_id, event_id, value, rank FROM (
      SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
    WHERE rank <= 3""",
)
def topk_per_row(spark, sf):
    return ops.topk_per_row(
        v.table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 3
    )


@query(
    "tar_roundtrip",
    """SELECT d.doc_id, 'docs-' || lpad(CAST((row_number() OVER (ORDER BY d.doc_id) - 1) // 64 AS VARCHAR), 6, '0') || '.tar' AS shard,
    coalesce(d.lang, '') AS lang, octet_length(encode(coalesce(d.text, '')))::BIGINT AS n_bytes, md5(coalesce(d.text, '')) AS text_md5 FROM documents d""",
)
def tar_roundtrip(spark, sf):
    """Documents as members of tar shards of 64 samples, written by tasks, committed by a manifest, read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "text")
    # a bucket's texts are sorted in one task, so buckets are narrow
    samples = dense_index(docs, ["doc_id"], int_bucket("doc_id", 2048)).select(
        "row_id",
        F.format_string("%012d", "doc_id").alias("key"),
        F.create_map(
            F.lit("txt"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit("lang"), F.encode(F.coalesce("lang", F.lit("")), "UTF-8")
        ).alias("members"),
    )
    tar_shards.write_shards(ops.assign_shards(samples, 64, "docs-%06d.tar"), folder)
    back = tar_shards.read_shards(spark, tar_shards.committed_shards(folder))
    text = F.element_at("members", "txt")
    return back.select(
        F.col("key").cast("long").alias("doc_id"),
        F.element_at(F.split("shard", "/"), -1).alias("shard"),
        F.decode(F.element_at("members", "lang"), "UTF-8").alias("lang"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.md5(text).alias("text_md5"),
    )
