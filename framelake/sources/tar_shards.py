"""Tar shards of samples as a Spark data source.

Read: one partition per shard, or per run of shards where there are more than `READERS`; members named `key.ext` are grouped into one row
(key, shard, members MAP<ext, bytes>). Shards are streamed, so memory holds one
sample at a time. Options: `prefixes` (comma list) keeps only matching members
before their bytes are read; `data_dir` resolves relative shard names.

Write: rows (shard_file, key, members), clustered by shard_file. Every task writes
attempt files under hidden names, and the commit lists those of successful tasks in a
manifest, written last and in one piece. Readers follow a folder's manifest, so a lost
executor or driver leaves nothing that can be read. Where renaming is cheap and atomic
the commit gives the files their final names first; on an object store the manifest
alone maps names to files.

Paths are those of any file system that `pyarrow.fs` opens by URI; a folder without a
manifest, such as one written elsewhere, is read by its file names.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from ..functions.paths import expand_shards
from ..schemas import SAMPLES

FORMAT = "tarshards"
MANIFEST = "_shards.json"
#: Most partitions of a read: a task costs about as much as a small shard.
READERS = 1024
#: File systems on which a file is renamed at once.
RENAMING = ("local", "hdfs")


def split_member(name: str) -> tuple[str, str]:
    """(key, extension): the file name is cut at its first dot, the folder belongs to the key."""
    folder, _, base = name.rpartition("/")
    stem, _, extension = base.partition(".")
    return (f"{folder}/{stem}" if folder else stem), extension


def read_manifest(folder: str) -> dict[str, str] | None:
    """Shard name to file name of a committed folder; None if the folder has no manifest."""
    system, path = fs.FileSystem.from_uri(folder)
    try:
        with system.open_input_stream(f"{path}/{MANIFEST}", compression=None) as stream:
            return json.loads(stream.read())["shards"]
    except FileNotFoundError:
        return None


class ShardPartition(InputPartition):
    def __init__(self, shards: list[tuple[str, str]]) -> None:
        self.shards = shards


class ShardReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.shards = expand_shards(options["path"].split(";"), options.get("data_dir"))
        prefixes = options.get("prefixes")
        self.prefixes = ("_", *prefixes.split(",")) if prefixes else None

    def partitions(self) -> list[InputPartition]:
        manifests: dict[str, dict[str, str] | None] = {}
        found = []
        for shard in self.shards:
            folder, _, name = shard.rpartition("/")
            if folder not in manifests:
                manifests[folder] = read_manifest(folder)
            listed = manifests[folder]
            if listed is not None and name not in listed:
                raise FileNotFoundError(f"{shard} is not among the committed shards of its folder")
            found.append((shard, shard if listed is None else f"{folder}/{listed[name]}"))
        size = max(1, -(-len(found) // READERS))
        return [ShardPartition(found[i : i + size]) for i in range(0, len(found), size)]

    def read(self, partition: ShardPartition) -> Iterator[tuple]:
        for shard, file in partition.shards:
            yield from self._samples(shard, file)

    def _samples(self, shard: str, file: str) -> Iterator[tuple]:
        key, members = None, {}
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
            for info in archive:
                if not info.isfile():
                    continue
                found, extension = split_member(info.name)
                if found != key:
                    if key is not None:
                        yield key, shard, members
                    key, members = found, {}
                if self.prefixes is None or extension.startswith(self.prefixes):
                    members[extension] = archive.extractfile(info).read()
        if key is not None:
            yield key, shard, members


@dataclass
class Written(WriterCommitMessage):
    files: list


class ShardWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool = False) -> None:
        self.folder, self.overwrite = folder, overwrite

    def write(self, rows: Iterator) -> Written:
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder, recursive=True)
        attempt, files = uuid.uuid4().hex, []
        archive = stream = current = None
        for row in rows:
            if row.shard_file != current:
                if archive is not None:
                    archive.close()
                    stream.close()
                if any(shard == row.shard_file for _, shard in files):
                    raise ValueError(f"rows of {row.shard_file} are not clustered")
                current = row.shard_file
                files.append((f".{attempt}.{current}", current))
                stream = system.open_output_stream(f"{folder}/{files[-1][0]}", compression=None)
                archive = tarfile.open(fileobj=stream, mode="w|")
            for extension, content in sorted(row.members.items()):
                info = tarfile.TarInfo(f"{row.key}.{extension}")
                info.size = len(content)
                archive.addfile(info, io.BytesIO(content))
        if archive is not None:
            archive.close()
            stream.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder, recursive=True)
        shards = {shard: file for message in messages if message for file, shard in message.files}
        if system.type_name in RENAMING:
            for shard, file in shards.items():
                system.move(f"{folder}/{file}", f"{folder}/{shard}")
            shards = {shard: shard for shard in shards}
        self._publish(system, folder, shards)
        if self.overwrite:
            held = {MANIFEST, *shards.values()}
            for entry in system.get_file_info(fs.FileSelector(folder)):
                if entry.base_name.endswith(".tar") and entry.base_name not in held:
                    system.delete_file(entry.path)

    def _publish(self, system: fs.FileSystem, folder: str, shards: dict[str, str]) -> None:
        target = f"{folder}/{MANIFEST}"
        # an object appears when it is closed; elsewhere a rename makes it appear
        path = f"{folder}/.{uuid.uuid4().hex}.json" if system.type_name in RENAMING else target
        with system.open_output_stream(path, compression=None) as stream:
            stream.write(json.dumps({"shards": shards}).encode())
        if path != target:
            system.move(path, target)

    def abort(self, messages: list) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        for message in messages:
            for file, _ in message.files if message else []:
                if system.get_file_info(f"{folder}/{file}").type != fs.FileType.NotFound:
                    system.delete_file(f"{folder}/{file}")


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SAMPLES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShardReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        folder = self.options["path"]
        system, path = fs.FileSystem.from_uri(folder)
        entries = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        # hidden files are what a lost job left
        shards = [e for e in entries if e.base_name.endswith(".tar") and not e.base_name.startswith(".")]
        if not overwrite and (shards or read_manifest(folder)):
            raise FileExistsError(f"{folder} already holds shards")
        return ShardWriter(folder, overwrite)


def read_shards(spark: SparkSession, shards: str | list[str], prefixes: tuple = (), data_dir: str | None = None) -> DataFrame:
    spark.dataSource.register(TarShards)
    reader = spark.read.format(FORMAT).option("path", shards if isinstance(shards, str) else ";".join(shards))
    if prefixes:
        reader = reader.option("prefixes", ",".join(prefixes))
    if data_dir is not None:
        reader = reader.option("data_dir", data_dir)
    return reader.load()


def committed_shards(folder: str) -> list[str]:
    """Paths of the shards that a finished write left in a folder."""
    listed = read_manifest(folder)
    if listed is None:
        raise FileNotFoundError(f"no finished shards in {folder}")
    return [f"{folder}/{name}" for name in sorted(listed)]


def write_shards(samples: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes rows (shard_file, shard_pos, key, members); see `sampling.assign_shards`."""
    samples.sparkSession.dataSource.register(TarShards)
    clustered = samples.repartition("shard_file").sortWithinPartitions("shard_file", "shard_pos")
    rows = clustered.select("shard_file", "key", "members")
    rows.write.format(FORMAT).option("path", folder).mode("overwrite" if overwrite else "append").save()


ARRAY = T.StructType(
    [
        T.StructField("shape", T.ArrayType(T.LongType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


@F.pandas_udf(ARRAY)
def decode_npy(content: pd.Series) -> pd.DataFrame:
    """`.npy` bytes to shape and flat values, row-major."""
    arrays = [np.load(io.BytesIO(b), allow_pickle=False) for b in content]
    return pd.DataFrame(
        {
            "shape": [list(a.shape) for a in arrays],
            "values": [a.astype("float64").ravel() for a in arrays],
        }
    )


@F.pandas_udf(T.BinaryType())
def encode_npy(values: pd.Series, shape: pd.Series, dtype: pd.Series) -> pd.Series:
    out = []
    for v, s, d in zip(values, shape, dtype):
        buffer = io.BytesIO()
        np.save(buffer, np.asarray(v).reshape(tuple(s)).astype(d))
        out.append(buffer.getvalue())
    return pd.Series(out)
