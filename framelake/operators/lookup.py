"""Keyed lookups with the rules of an index: unique, missing, ambiguous."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_keys(index: DataFrame, keys: Sequence[str], row: str = "row_id") -> DataFrame:
    """(keys, row, copies): the row id of a key, null when several rows share it."""
    grouped = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(row).alias("__row"))
    return grouped.withColumn(row, F.when(F.col("copies") == 1, F.col("__row"))).drop("__row")


def lookup_unique_key(
    requests: DataFrame, index: DataFrame, keys: Sequence[str], row: str = "row_id", strict: bool = False
) -> DataFrame:
    """Adds row and status (found / missing / ambiguous) to every request.

    In strict mode a request without exactly one row fails the job.
    """
    # only rows of requested keys are grouped
    wanted = index.join(requests.select(*keys).distinct(), list(keys), "left_semi")
    found = requests.join(unique_keys(wanted, keys, row), list(keys), "left")
    status = (
        F.when(F.col("copies").isNull(), "missing").when(F.col("copies") > 1, "ambiguous").otherwise("found")
    )
    if strict:
        key_text = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        status = F.when(F.col("copies") == 1, "found").otherwise(
            F.raise_error(F.concat(F.lit("ambiguous or missing key: "), key_text))
        )
    return found.withColumn("status", status).drop("copies")


def multi_get(
    requests: DataFrame, table: DataFrame, key: str, position: str = "position", strict: bool = True
) -> DataFrame:
    """Rows of `table` for every request (position, key), repeats included, ordered by position.

    An id that the table lacks is an error in strict mode, otherwise it is left out.
    """
    if not strict:
        return requests.join(table, key).orderBy(position)
    marked = table.withColumn("__hit", F.lit(True))
    checked = requests.join(marked, key, "left").withColumn(
        key,
        F.when(F.col("__hit"), F.col(key)).otherwise(
            F.raise_error(F.concat(F.lit("missing row: "), F.col(key).cast("string")))
        ),
    )
    return checked.drop("__hit").orderBy(position)
