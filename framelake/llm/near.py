"""One document of each group of near copies: SimHash links first, bands for what they can't reach, exact Jaccard decides.

Sets are the distinct runs of five words of a text (`minhash.shingles`). Two texts link if the
Jaccard similarity of their sets is at least `similar`; texts without words are copies of each other.
Groups are the connected components of the links.

Candidates come from two indexes. The Gray-order index of `simhash` links the sets' 64-bit SimHash
fingerprints at three differing bits. At a similarity of 0.8 about ten of 64 bits differ, and no
radius that an index over 64 bits can serve reaches that, so the bands of `minhash` give
the other pairs, with their miss probability. All candidates, whichever index they come from, are
verified together on full sets (`minhash.Copies`), each set shipped once for a cluster that fits a
task. So no pair below the threshold joins a group.

Kept is the row with the smallest doc_id of a group (nulls come last), of several such rows that with
the smallest 128-bit hash of the whole row; repeats of that row go. Null and empty texts are one
group, very long texts are read whole, other columns of any name are kept as they are, and an empty
table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, simhash
from .scratch import stored

SHINGLE = 5
SIMILAR = (4, 5)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set as a signed long: a bit is set if it is in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(found), simhash.COUNTED):
        part = found[low : low + simhash.COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


class NearCopies(minhash.Copies):
    """Copies whose candidates also come from SimHash links."""

    mark = staticmethod(fingerprint)

    def may_link(self) -> DataFrame:
        marked = self.sets.filter("n > 0").select("id", "fp")
        distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
        first = [distinct.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_id")) for end in ("a", "b")]
        found = simhash.links(distinct.select("fp")).join(first[0], "a").join(first[1], "b")
        equal = marked.join(distinct, "fp").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        close = found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        return super().may_link().unionByName(equal).unionByName(close)


def groups(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, **bounds: int) -> DataFrame:
    """doc_id, c1, c2, root for each row of docs; c1, c2: hashes of the row, root: the same for all rows of a group."""
    copies = NearCopies(docs, shingle, similar, **bounds)
    return copies.marked.select("doc_id", "c1", "c2", "code").join(copies.roots().select("code", "root"), "code").drop("code")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, **bounds: int) -> DataFrame:
    """One row of docs for each group."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c1", "c2")).alias("first")
    kept = groups(docs, shingle, similar, **bounds).groupBy("root").agg(first).select("first.c1", "first.c2").distinct()
    rows = docs.select(*minhash.identity(docs), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(kept, ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(F.first("row").alias("row")).select("row.*")
