"""Byte-level BPE over texts: overlapping chunks, stitched pieces, exact ids, raw-byte decoding.

`encode_documents` gives each text the ids that a sequential encoder gives. A text of at most
`chunk` characters is one chunk. A longer one is cut into chunks that overlap by `overlap`
characters; the chunks are spread over the cluster and each is split into pre-tokens from its own
start, whatever that start cuts through. Matching depends only on what lies to the right of a
boundary, so once two neighbours share a boundary in their overlap they agree from there on: the
first shared boundary after a character that is not white space becomes the cut (behind white
space the encoder would look ahead past the cut). Cuts are trusted from the left; if a pair of
chunks never meets, the rest of that text is encoded as one piece. Then the pieces are encoded in
parallel and a streaming pass per text folds their ids in order into the digests.

Null texts count as empty, which have no ids. Repeated rows each give a row.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 32_768
OVERLAP = 256
#: Where no two white space characters meet, the pattern's look-ahead changes nothing and is left out:
#: without it the pattern runs on a plain automaton.
_WIDE_SPACE = re.compile(r"\s\s")
_LOOK_AHEAD = r"\s+(?!\S)|"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self._exact, self._narrow = (
            tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            for pattern in (public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(_LOOK_AHEAD, ""))
        )

    def encode(self, text: str) -> bytes:
        ids = self._exact(text) if _WIDE_SPACE.search(text) else self._narrow(text)
        return np.array(ids, dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def encoder(rank_file: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(rank_file)


def boundaries(text: str, start: int, whole: bool, zones: list[tuple[int, int]]) -> list[list[int]]:
    """Ends of pre-tokens that lie in each zone [from, to) and follow a character that is no white space.

    Positions count from the document's start, where this text begins at `start`. An end that
    touches the end of a text that goes on (`whole` is false) isn't known yet.
    """
    found: list[list[int]] = [[] for _ in zones]
    last = len(text)
    for match in regex.finditer(public_tokenizers.PATTERN, text):
        end = match.end()
        if (end < last or whole) and not text[end - 1].isspace():
            for zone, (low, high) in zip(found, zones):
                if low <= start + end < high:
                    zone.append(start + end)
    return found


def _cut_chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                count = -(-len(text) // chunk)
                for low in range(0, count, 64):
                    at = range(low, min(low + 64, count))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": [row] * len(at),
                            "doc_id": pa.array([doc_id] * len(at), pa.int64()),
                            "part": list(at),
                            "parts": [count] * len(at),
                            "body": [text[i * chunk : (i + 1) * chunk + overlap] for i in at],
                        }
                    )

    return run


def _mark_chunks(chunk: int, overlap: int):
    ints = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            heads, tails = [], []
            for part, parts, body in zip(rows["part"], rows["parts"], rows["body"]):
                start, end = part * chunk, (part + 1) * chunk
                head, tail = boundaries(body, start, part + 1 == parts, [(start, start + overlap), (end, end + overlap)])
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_pydict(
                {"row": rows["row"], "part": rows["part"], "head": pa.array(heads, ints), "tail": pa.array(tails, ints)}
            )

    return run


def _encode_pieces(rank_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(rank_file).encode
        for batch in batches:
            rows = batch.to_pydict()
            yield pa.RecordBatch.from_pydict(
                {
                    "row": rows["row"],
                    "doc_id": pa.array(rows["doc_id"], pa.int64()),
                    "part": rows["part"],
                    "ids": pa.array([encode(text) for text in rows["piece"]], pa.binary()),
                }
            )

    return run


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    ids, counts, encoded, decoded = zip(*rows)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": list(encoded),
            "decoded_sha256": list(decoded),
        }
    )


def _encode_single(rank_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(rank_file)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = codec.encode(text.as_py())
                back = hashlib.sha256(codec.decode(ids)).hexdigest()
                rows.append((doc_id.as_py(), len(ids) // 4, hashlib.sha256(ids).hexdigest(), back))
            if rows:
                yield _result(rows)

    return run


def _fold_pieces(rank_file: str):
    """Rows of a text lie together, in order; digests are fed piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now = encoder(rank_file), None
        for batch in batches:
            done = []
            for row, doc_id, ids in zip(*(batch.column(name) for name in ("row", "doc_id", "ids"))):
                row, ids = row.as_py(), ids.as_py()
                if now is None or now[0] != row:
                    if now:
                        done.append((now[1], now[2], now[3].hexdigest(), now[4].hexdigest()))
                    now = [row, doc_id.as_py(), 0, hashlib.sha256(), hashlib.sha256()]
                now[2] += len(ids) // 4
                now[3].update(ids)
                now[4].update(codec.decode(ids))
            if done:
                yield _result(done)
        if now:
            yield _result([(now[1], now[2], now[3].hexdigest(), now[4].hexdigest())])

    return run


def stitched_pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, part, piece): the texts cut where neighbouring chunks meet, in order of part."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = rows.mapInArrow(
        _cut_chunks(chunk, overlap), "row long, doc_id long, part long, parts long, body string"
    ).repartition("row", "part")
    marks = chunks.select("row", "part", "parts", "body").mapInArrow(
        _mark_chunks(chunk, overlap), "row long, part long, head array<long>, tail array<long>"
    )
    order = Window.partitionBy("row").orderBy("part")
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    cuts = (
        marks.withColumn("cut", F.when(F.col("part") == 0, F.lit(0)).otherwise(meet))
        .withColumn("lost", F.max(F.col("cut").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next_lost", F.lead("lost").over(order))
        .select(
            "row",
            "part",
            F.when(F.col("lost"), F.col("part") * chunk).otherwise(F.col("cut")).alias("low"),
            F.when(F.col("next_lost"), (F.col("part") + 1) * chunk).otherwise(F.lead("cut").over(order)).alias("high"),
            (F.col("lost") | F.coalesce("next_lost", F.lit(False))).alias("joined"),
        )
    )
    start = F.col("part") * chunk
    own = chunks.join(cuts, ["row", "part"]).select(
        "row",
        "doc_id",
        "part",
        "joined",
        F.col("body")
        .substr(
            (F.col("low") - start + 1).cast("int"),
            F.coalesce(F.col("high") - F.col("low"), F.lit(chunk + overlap)).cast("int"),
        )
        .alias("piece"),
    )
    rest = (
        own.filter("joined")
        .groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("all"))
        .select("row", "doc_id", F.col("all")[0]["part"].alias("part"), F.array_join("all.piece", "").alias("piece"))
    )
    return own.filter("not joined").select("row", "doc_id", "part", "piece").unionByName(rest)


def encode_documents(
    docs: DataFrame, rank_file: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are left out)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = texts.filter(F.length("text") <= chunk).mapInArrow(_encode_single(rank_file), _RESULT)
    pieces = stitched_pieces(texts.filter(F.length("text") > chunk), chunk, overlap)
    ids = pieces.mapInArrow(_encode_pieces(rank_file), "row long, doc_id long, part long, ids binary")
    folded = ids.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_fold_pieces(rank_file), _RESULT)
    return short.unionByName(folded)
