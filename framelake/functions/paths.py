"""File name templates and shard lists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .integers import div

_FIELD = re.compile(r"\{(\w+)(?::0?(\d+)d)?\}")
_SCHEME = re.compile(r"[A-Za-z][\w+.-]+:/")
_RANGE = re.compile(r"\{(\d+)\.\.(\d+)\}")


def episode_path(template: str, episode: Column, chunks_size: int = 1000, video_key: str | None = None) -> Column:
    """Path of an episode file from a template with episode_chunk, chunk_index, file_index, episode_index, video_key."""
    chunk = div(episode, chunks_size)
    values = {
        "episode_chunk": chunk,
        "chunk_index": chunk,
        "episode_index": episode,
        "file_index": episode,
        "video_key": F.lit(video_key or ""),
    }
    parts, last = [], 0
    for match in _FIELD.finditer(template):
        name, width = match.groups()
        if name not in values:
            raise ValueError(f"unknown field `{name}` in path template")
        parts.append(F.lit(template[last : match.start()]))
        text = values[name].cast("string")
        # A longer number keeps all its digits.
        parts.append(F.lpad(text, F.greatest(F.lit(int(width)), F.length(text)), F.lit("0")) if width else text)
        last = match.end()
    return F.concat(*parts, F.lit(template[last:]))


def expand_shards(shards: str | Iterable | None, data_dir: str | None = None) -> list[str]:
    """Shard list from a name, a name with `{000..123}`, or nested lists of them.

    Absolute paths and URIs stay as they are; a relative one needs `data_dir`.
    """
    if shards is None:
        return []
    if not isinstance(shards, str):
        return [url for item in shards for url in expand_shards(item, data_dir)]
    if not shards.startswith("/") and not _SCHEME.match(shards):
        if data_dir is None:
            raise ValueError(f"relative shard path {shards} needs a data folder")
        shards = f"{data_dir.rstrip('/')}/{shards}"
    match = _RANGE.search(shards)
    if match is None:
        return [shards]
    low, high = match.groups()
    names = (
        shards[: match.start()] + str(i).zfill(len(low)) + shards[match.end() :]
        for i in range(int(low), int(high) + 1)
    )
    return [url for name in names for url in expand_shards(name, data_dir)]
