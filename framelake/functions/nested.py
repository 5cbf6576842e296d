"""Reading and writing values inside structs, maps, arrays and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _step(column: Column, dtype: T.DataType, name: str) -> tuple[Column | None, T.DataType | None]:
    if isinstance(dtype, T.StructType):
        match = [f for f in dtype.fields if f.name == name]
        return (column.getField(name), match[0].dataType) if match else (None, None)
    if isinstance(dtype, T.MapType):
        return F.try_element_at(column, F.lit(name)), dtype.valueType
    if isinstance(dtype, T.ArrayType) and name.lstrip("-").isdigit():
        position = int(name)
        return F.get(column, F.lit(position) if position >= 0 else F.size(column) + position), dtype.elementType
    return None, None


def read_path(schema: T.StructType, path: str, strict: bool = True) -> Column:
    """Column for a dotted path such as `a.b.0`.

    A path that the schema cannot hold is an error (`strict`) or a null column;
    in strict mode a null met at run time also fails the job.
    """
    first, *rest = path.split(".")
    column, dtype = (F.col(f"`{first}`"), schema[first].dataType) if first in schema.names else (None, None)
    for name in rest:
        if column is None:
            break
        column, dtype = _step(column, dtype, name)
    if column is None:
        if strict:
            raise ValueError(f"path `{path}` does not exist in the schema")
        return F.lit(None).cast("string")
    if strict:
        return F.when(column.isNotNull(), column).otherwise(
            F.raise_error(F.lit(f"path `{path}` is null"))
        )
    return column


def write_path(path: str, value: Column) -> tuple[str, Column]:
    """(column name, new column) that sets a field inside a struct column; for `withColumn`."""
    first, _, rest = path.partition(".")
    return first, (F.col(first).withField(rest, value) if rest else value)


def json_path(column: Column | str, path: str, default: Column | None = None) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    found = F.get_json_object(column, "$." + path)
    return found if default is None else F.coalesce(found, default)
