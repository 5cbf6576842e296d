"""Token counts kept up to date by deltas.

A store holds additive totals by source, language and tokenizer version. A batch of changes is summed
to one signed delta for each key and becomes part of the store by a single rename of a finished
folder to `deltas/<batch>`; a batch whose folder exists has been committed and is skipped. So a
batch that is sent again, by a retry or after a crash, changes nothing, and readers see all of it or none.
Totals are the sum of a snapshot and of the deltas that it doesn't hold. `compact` writes a
new snapshot; the last complete one is in use, and older ones stay for readers that have begun.

Changes are rows of (source, lang, tokenizer, change, tokens, old_tokens):

* `insert`: a document with `tokens`;
* `delete`: a document that counted `old_tokens`;
* `revise`: a document that counted `old_tokens` and counts `tokens` now.

Sums are made in the tasks before rows move, so a source with most of the rows is no hot group. Null
sources, languages and versions are keys of their own; null counts are zero; other kinds of change
fail. Keys whose documents and tokens are all gone leave the totals. Repeated rows count each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder

KEY = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of the changes of each key."""
    kind = F.col("change")
    known = F.when(kind.isin("insert", "delete", "revise"), kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(kind, F.lit("null"))))
    )
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(known == "insert", 1).when(known == "delete", -1).otherwise(0)
    tokens = F.when(kind == "insert", new).when(kind == "delete", -old).otherwise(new - old)
    return changes.groupBy(*KEY).agg(
        F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens.cast("long")).alias("n_tokens")
    )


class RollupStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), hadoop)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _finish(self, pending: str, name: str) -> bool:
        """Renames a finished folder; False if the name is taken, also by a writer at the same time."""
        self._files.mkdir(self._at(name).getParent(), None, True)
        options = self._jvm.org.apache.hadoop.fs.Options
        keep = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
        keep[0] = getattr(getattr(options, "Rename"), "NONE")
        try:
            self._files.rename(self._at(pending), self._at(name), keep)
        except Exception:
            if not self._exists(name):
                raise
            self._files.delete(self._at(pending), True)
            return False
        return True

    def _exists(self, name: str) -> bool:
        return self._files.util().exists(self._at(name))

    def _names(self, folder: str) -> list[str]:
        if not self._exists(folder):
            return []
        return sorted(status.getPath().getName() for status in self._files.util().listStatus(self._at(folder)))

    def committed(self, batch: str) -> bool:
        return self._exists(f"deltas/{batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once; False if the store holds it already."""
        if not _NAME.fullmatch(batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        pending = f"pending/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{pending}")
        return self._finish(pending, f"deltas/{batch}")

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of every key that isn't empty.

        batches: those to count, besides what the snapshot holds; all that are committed by default.
        """
        snapshots = self._names("snapshots")
        held: set[str] = set()
        paths = []
        if snapshots:
            latest = f"{self.path}/snapshots/{snapshots[-1]}"
            held = {row["batch"] for row in self.spark.read.schema("batch string").json(f"{latest}/batches").collect()}
            paths.append(f"{latest}/totals")
        paths += [f"{self.path}/deltas/{name}" for name in (self._names("deltas") if batches is None else batches) if name not in held]
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        sums = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Writes a snapshot of all batches committed so far."""
        batches, last = self._names("deltas"), self._names("snapshots")
        pending = f"pending/{uuid.uuid4().hex}"
        number = int(last[-1]) + 1 if last else 0
        self.totals(batches).write.parquet(f"{self.path}/{pending}/totals")
        names = self.spark.createDataFrame([(name,) for name in batches], "batch string")
        names.coalesce(1).write.json(f"{self.path}/{pending}/batches")
        self._finish(pending, f"snapshots/{number:08d}")


def _counted(rank_files: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {version: encoder(path) for version, path in rank_files.items()}
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column("text")]
            counts = {v: pa.array([len(e.encode(t)) // 4 for t in texts], pa.int64()) for v, e in encoders.items()}
            kept = batch.drop_columns("text")
            yield pa.RecordBatch.from_arrays([*kept.columns, *counts.values()], [*kept.schema.names, *counts])

    return run


def token_counts(docs: DataFrame, rank_files: dict[str, str]) -> DataFrame:
    """source, lang, the texts' characters and UTF-8 bytes, and a column of counts for each tokenizer version.

    Null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "source", "lang", F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), "text"
    )
    columns = ", ".join(f"`{version}` long" for version in rank_files)
    return rows.mapInArrow(_counted(rank_files), f"source string, lang string, chars long, bytes long, {columns}")


def changes(counts: DataFrame, tokenizer: str, change: str, tokens: str | None = None, old_tokens: str | None = None) -> DataFrame:
    """Rows of `counts` as changes of one tokenizer version."""
    return counts.select(
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(change).alias("change"),
        *((F.col(f"`{c}`") if c else F.lit(None).cast("long")).alias(n) for c, n in ((tokens, "tokens"), (old_tokens, "old_tokens"))),
    )
