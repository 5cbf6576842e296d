"""Connected components of a table of links, by repeated contraction.

In each round every vertex moves to the lowest-ranked one among itself and its neighbours; links
are renamed, and what has become a loop or a repeat is dropped. Ranks are hashes that change every
second round, so an expected constant share of the vertices goes in each two rounds, also along chains,
and a hub and its neighbours are one vertex after two: in the first the hub takes the lowest rank among them, in
the second all move there. (With new ranks in each round a star of n takes about ln n rounds.) Each round is a few joins on vertices; its tables are
written to the shared folder, as the next round reads them more than once. A vertex with very many
links is no hot group for the minimum (pre-aggregated in the tasks), and Spark splits its joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of the links (a, b); equal roots mean connected.

    Repeated links, both directions and loops are harmless; links with a null end are left out. No
    links give no rows.
    """
    links = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    moves: list[DataFrame] = []
    while not links.isEmpty():
        seed = F.lit(len(moves) // 2)
        rank = F.xxhash64(seed, "to")
        both = links.select(F.col("a").alias("vertex"), F.col("b").alias("to")).unionByName(
            links.select(F.col("b").alias("vertex"), F.col("a").alias("to"))
        )
        lowest = both.groupBy("vertex").agg(F.min(F.struct(rank.alias("rank"), "to")).alias("low"))
        own = F.struct(F.xxhash64(seed, "vertex").alias("rank"), F.col("vertex").alias("to"))
        move = stored(lowest.select("vertex", F.least("low", own)["to"].alias("to")), "moves")
        moves.append(move)
        for end in ("a", "b"):
            links = links.join(move.select(F.col("vertex").alias(end), F.col("to").alias(f"new_{end}")), end)
        links = stored(
            links.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
            .filter("a <> b")
            .distinct(),
            "links",
        )
    if not moves:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    roots = moves[0].select("vertex", F.col("to").alias("root"))
    for move in moves[1:]:
        later = move.select(F.col("vertex").alias("root"), "to")
        roots = roots.join(later, "root", "left").select("vertex", F.coalesce("to", "root").alias("root"))
    return roots
