"""Web archives: records written, indexed by an external merge, and read back.

Pages become WARC records, each a gzip member of its own. Of pages with equal payloads of at least
`least` bytes, that with the smallest page_id is stored as a response and the others as revisits that
refer to it; payloads below that size are all stored. Each writing task keeps the captures it
has written and gives them out as a run sorted by URL key and timestamp. The runs are merged
externally: ranges of the order, with bounds sampled from the runs, are dealt to tasks; a task
gets each run's slice of its range and merges the slices through a tree of losers, one comparison a
level for each capture. Ranges follow the whole order (key, timestamp, page), so a key with very many
captures is cut over several. The merged index holds the captures' histories in global order:
(`index_part`, `index_place`). The archives are read through the merged index: its entries are dealt to
tasks by file, and each finds its record by the offset.

Writing tasks name their files by a fresh id and only files named in a finished index count, so a task
that runs again after a loss leaves no half archive behind in the results. Files live in the shared
folder and are reached through their URI.

Null pages are empty payloads, which are equal to each other. A null page_id counts as larger than any
other; repeated page_ids with equal payloads count in the order of their URLs, the first being the
lowest. Every page gives a record; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .scratch import new_path, stored

#: Bytes after which a task begins a new archive file, and that are read at a time.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
LEVEL = 1
#: Captures that one task merges, about.
ROWS_PER_TASK = 50_000
#: Captures that a task holds before it gives out a sorted run.
RUN_ROWS = 100_000
#: Pages carry no time of capture: a page's is this many seconds since 1970, plus its page_id.
FIRST_CAPTURE = 1_704_067_200

_INDEX = (
    "run string, place long, url_key string, timestamp long, page long, page_id long, file string, offset long"
)
_NO_PAGE = (1 << 63) - 1


def url_key(url: Column) -> Column:
    """Host labels from the top level down, then port, path and query, in lower case; no scheme, user or fragment."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://([^/?#@]*@)?|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(plain, r"^[^/?:]*", 0), r"^www[0-9]*\.", "")
    rest = F.regexp_replace(F.regexp_extract(plain, r"^[^/?:]*(.*)$", 1), r"^:(80|443)(?=/|\?|$)", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with their payload, and `original`: the page_id of the response that a revisit refers to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    page = F.coalesce("page_id", F.lit(_NO_PAGE)).alias("page")
    digest = F.sha1(F.col("payload").cast("binary")).alias("digest")
    large = F.octet_length("payload") >= least
    # small rows decide; payloads move once, by their page
    small = rows.filter(large).select(page, digest)
    firsts = small.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeats = small.distinct().join(firsts, "digest").select(_record_key().alias("key"), "first")
    marked = rows.select("*", page, digest).withColumn("key", _record_key())
    joined = marked.join(repeats, "key", "left")
    order = Window.partitionBy("key").orderBy("url")
    copy = F.when(F.col("first").isNotNull(), F.row_number().over(order) - 1).otherwise(0)
    numbered = joined.withColumn("copy", copy)
    revisit = (F.col("first") < F.col("page")) | ((F.col("first") == F.col("page")) & (F.col("copy") > 0))
    return numbered.select(
        "page_id",
        "page",
        "url",
        url_key(F.col("url")).alias("url_key"),
        "payload",
        F.coalesce(revisit, F.lit(False)).alias("revisit"),
        F.when(revisit, F.col("first")).alias("original"),
        "copy",
    )


def _record_key() -> Column:
    return F.concat_ws("/", F.col("page").cast("string"), F.col("digest"))


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page: int, digest: str, copy: int) -> str:
    return f"<urn:page:{page}:{digest}:{copy}>"


def record(page: int, url: str, seconds: int, payload: bytes, original: int | None, copy: int) -> bytes:
    """A WARC 1.1 record; a revisit has no payload, but its length and digest."""
    digest = base32(payload)
    date = "{}-{:02}-{:02}T{:02}:{:02}:{:02}Z".format(*_utc(seconds))
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + (payload if original is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(url.splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        lines += [
            f"WARC-Refers-To: {_record_id(original, digest, 0)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _utc(seconds: int) -> tuple[int, ...]:
    days, rest = divmod(seconds, 86_400)
    era, day = divmod(days + 719_468, 146_097)  # civil date of a day number, years from March
    year = (day - day // 1460 + day // 36_524 - day // 146_096) // 365
    day -= 365 * year + year // 4 - year // 100
    month = (5 * day + 2) // 153
    return (
        year + 400 * era + (month >= 10),
        month + 3 if month < 10 else month - 9,
        day - (153 * month + 2) // 5 + 1,
        rest // 3600,
        rest // 60 % 60,
        rest % 60,
    )


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _opened(folder)
        stream = name = None
        held: list[tuple] = []
        for batch in batches:
            for page_id, page, url, key, payload, revisit, original, copy in zip(*(c for c in batch.columns)):
                page, original = page.as_py(), original.as_py()
                if stream is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    stream = files.open_output_stream(f"{at}/{name}", compression=None)
                # beyond the years that a date can show, pages share the first time
                seconds = FIRST_CAPTURE + (page if 0 <= page < 10**11 else 0)
                plain = record(page, url.as_py() or "", seconds, (payload.as_py() or "").encode(), original, copy.as_py())
                packer = zlib.compressobj(LEVEL, wbits=31)
                held.append((key.as_py(), seconds, page, page_id.as_py(), name, stream.tell()))
                stream.write(packer.compress(plain) + packer.flush())
                if stream.tell() >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
            while len(held) >= RUN_ROWS:
                yield _run(held[:RUN_ROWS])
                held = held[RUN_ROWS:]
        if stream is not None:
            stream.close()
        if held:
            yield _run(held)

    return run


def _run(held: list[tuple]) -> pa.RecordBatch:
    """Captures as a sorted run."""
    keys, seconds, pages, ids, names, offsets = zip(*sorted(held, key=lambda row: (row[:3], row[4:])))
    return pa.RecordBatch.from_pydict(
        {
            "run": [uuid.uuid4().hex] * len(held),
            "place": pa.array(range(len(held)), pa.int64()),
            "url_key": list(keys),
            "timestamp": pa.array(seconds, pa.int64()),
            "page": pa.array(pages, pa.int64()),
            "page_id": pa.array(ids, pa.int64()),
            "file": list(names),
            "offset": pa.array(offsets, pa.int64()),
        }
    )


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes archives to the folder (URI); the captures as sorted runs."""
    files, at = _opened(folder)
    files.create_dir(at, recursive=True)
    return captures(pages, least).mapInArrow(_write(folder), _INDEX)


class LoserTree:
    """Merges sorted iterators; each step replays the matches on one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = len(runs)
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * self.size
        for i in range(self.size):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        """An empty run loses; ties go to the earlier run."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node:
            if self.losers[node] < 0:  # the match waits for its other side
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.size:
            winner = self.losers[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lie by run and place: the slices of all runs in one range."""
    runs: list[list[tuple]] = []
    last = None
    for batch in batches:
        rows = batch.to_pydict()
        fields = ("url_key", "timestamp", "page", "file", "offset", "page_id")
        for run, *row in zip(rows["run"], *(rows[f] for f in fields)):
            if run != last:
                runs.append([])
                last = run
            runs[-1].append(tuple(row))
    merged = list(LoserTree([iter(run) for run in runs]))
    if merged:
        keys, seconds, _, names, offsets, _ = zip(*merged)
        yield pa.RecordBatch.from_pydict(
            {
                "index_part": pa.array([TaskContext.get().partitionId()] * len(merged), pa.int32()),
                "index_place": pa.array(range(len(merged)), pa.int64()),
                "url_key": list(keys),
                "timestamp": pa.array(seconds, pa.int64()),
                "file": list(names),
                "offset": pa.array(offsets, pa.int64()),
            }
        )


def merge(runs: DataFrame) -> DataFrame:
    """The captures of all runs in one order of (index_part, index_place)."""
    parts = max(1, runs.count() // ROWS_PER_TASK)
    ranged = runs.repartitionByRange(parts, "url_key", "timestamp", "page", "file", "offset")
    return ranged.sortWithinPartitions("run", "place").mapInArrow(
        _merge, "index_part int, index_place long, url_key string, timestamp long, file string, offset long"
    )


def members(files: fs.FileSystem, path: str) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, read in pieces."""
    with files.open_input_stream(path, compression=None) as stream:
        offset, begin, rest = 0, 0, b""
        unpacker, parts = zlib.decompressobj(wbits=31), []
        while rest or (rest := stream.read(READ_BYTES)):
            offset += len(rest)
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
            if unpacker.eof:
                offset -= len(rest)
                yield begin, b"".join(parts)
                begin, unpacker, parts = offset, zlib.decompressobj(wbits=31), []
            else:
                rest = b""
        if any(parts):
            raise ValueError(f"{path} ends within a record")


_PAGE = re.compile(r"<urn:page:(-?[0-9]+):")


def parse(content: bytes) -> dict:
    """Fields of a record; a stored payload has to agree with its digest."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    kind = fields["WARC-Type"]
    if kind == "response":
        if base32(payload) != digest or len(payload) != length:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    original = _PAGE.match(fields.get("WARC-Refers-To", ""))
    return {
        "page_id": _page_id(int(_PAGE.match(fields["WARC-Record-ID"])[1])),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_id(int(original[1])) if original else None,
    }


def _page_id(page: int) -> int | None:
    return None if page == _NO_PAGE else page


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("index_part", pa.int32()),
        ("index_place", pa.int64()),
        ("url_key", pa.string()),
        ("timestamp", pa.int64()),
    ]
)
_RECORD_COLUMNS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "index_part int, index_place long, url_key string, timestamp long"
)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _read(folder: str):
    """Entries sorted by file and offset in step with the records of each file, which is read once from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _opened(folder)
        rows: list[dict] = []
        for name, entries in groupby(_entries(batches), key=lambda entry: entry["file"]):
            records = members(files, f"{at}/{name}")
            for entry in entries:
                content = next((content for offset, content in records if offset == entry["offset"]), None)
                if content is None:
                    raise ValueError(f"{name} has no record at {entry['offset']}")
                rows.append({**entry, **parse(content)})
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """Records of the archives that a merged index names, each with its place in the index.

    The index entries go to the task that reads their file, so records meet their entries there and nothing
    is joined or broadcast. There are as many reading tasks as files, a number given outright: small entries would
    otherwise be put together in one task, which would read all archives.
    """
    n_files = index.select("file").distinct().count()
    dealt = index.repartition(max(1, n_files), "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(folder), _RECORD_COLUMNS)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages through archives in the shared folder and back."""
    folder = new_path(pages.sparkSession, "warc")
    runs = stored(write(pages, folder, least), "runs")
    return read(stored(merge(runs), "index"), folder)
