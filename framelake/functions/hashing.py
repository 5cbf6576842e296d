"""Seeded pseudo-random columns built from md5, so any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys
    ]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


# 52 bits fill a double's mantissa, so even a table of trillions of rows is reached evenly.
HEX_DIGITS, SPAN = 13, 4503599627370496.0


def hash_bits(seed, *keys, offset: int = 0) -> Column:
    """52 bits of the digest as a non-negative long; `offset` gives independent draws of a key."""
    tag = f"{seed}/{offset}" if offset else seed
    return F.conv(F.substring(seeded_digest(tag, *keys), 1, HEX_DIGITS), 16, 10).cast("long")


def hash_uniform(seed, *keys, offset: int = 0) -> Column:
    """Uniform double in [0, 1)."""
    return hash_bits(seed, *keys, offset=offset) / F.lit(SPAN)


# Rows that a bucket of a digest holds on average, up to a factor of 16.
BUCKET_ROWS = 65536


def hash_bucket(digest: Column, rows: Column) -> Column:
    """Leading hex digits of a digest: buckets that follow digest order and fill evenly.

    `rows` is the number of rows or a bound of it; the digits grow with it.
    """
    digits = F.ceil(F.log(16.0, F.greatest(rows, F.lit(BUCKET_ROWS)) / BUCKET_ROWS))
    return F.substring(digest, F.lit(1), F.greatest(digits, F.lit(1)).cast("int"))
