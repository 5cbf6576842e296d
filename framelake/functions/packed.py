"""Vectors packed as little-endian floats in binary columns, coded a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Numpy types of the stored item types.
ITEM_TYPES = {"float16": "<f2", "float32": "<f4"}


def pack_matrix(matrix: Column, dtype: str) -> Column:
    """array<array<float>> as the bytes of its items, row by row.

    A null matrix stays null, a null item becomes not-a-number; a value above the largest half float becomes infinity.
    Matrices of a column may differ in size.
    """
    item = ITEM_TYPES[dtype]

    @F.arrow_udf("binary")
    def pack(rows: pa.Array) -> pa.Array:
        inner = rows.flatten()
        with np.errstate(over="ignore"):
            items = inner.flatten().to_numpy(zero_copy_only=False).astype(item)
        ends = np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False))]).astype("i8")
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = ends[np.concatenate([[0], np.cumsum(sizes)]).astype("i8")]
        data, width = items.tobytes(), np.dtype(item).itemsize
        missing = rows.is_null().to_pylist()
        cut = [None if gone else data[a * width : b * width] for gone, a, b in zip(missing, at, at[1:])]
        return pa.array(cut, pa.binary())

    return pack(matrix)


def unpack_matrix(packed: Column, slots: int, dim: int, dtype: str) -> Column:
    """The matrix of slots x dim floats; bytes of another length fail the job."""
    item = ITEM_TYPES[dtype]
    size = slots * dim * np.dtype(item).itemsize

    @F.arrow_udf("array<array<float>>")
    def unpack(rows: pa.Array) -> pa.Array:
        held = rows.drop_null()
        if any(len(value.as_buffer()) != size for value in held):
            raise ValueError(f"packed features differ from {slots} x {dim} items of {dtype}")
        data = b"".join(value.as_buffer().to_pybytes() for value in held)
        items = pa.array(np.frombuffer(data, item).astype("f4"))
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(items) + 1, dim), pa.int32()), items)
        present = rows.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(present * slots)]).astype("i4")
        offsets = [int(end) for end in ends]
        for i in np.flatnonzero(~present):
            offsets[i] = None  # an offset that is null makes its list null
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)

    return unpack(packed)
