"""Landed JSON: find the records, flatten what is nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col

#: Where records are looked for, in order (fixed values).
RECORD_KEYS = ("data", "results", "items", "records", "rows", "value", "payload")


def _array_at(schema: T.StructType, path: tuple[str, ...] = ()) -> tuple[str, ...] | None:
    fields = {f.name: f.dataType for f in schema}
    for name in RECORD_KEYS:
        kind = fields.get(name)
        if isinstance(kind, T.ArrayType):
            return (*path, name)
        if isinstance(kind, T.StructType):
            found = _array_at(kind, (*path, name))
            if found:
                return found
    return None


def read_records(spark: SparkSession, path: str, *, records: str | None = None, multiline: bool = False) -> DataFrame:
    """One row per record; nested values become JSON text.

    ``records`` is a dotted path; without one the first array under a usual
    name is taken, or the documents themselves are the records.
    """
    documents = spark.read.option("multiLine", multiline).json(path)
    place = tuple(records.split(".")) if records else _array_at(documents.schema)
    rows = documents
    if place:
        kind: T.DataType = documents.schema
        for name in place:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                raise ValueError(f"No records at {'.'.join(place)!r}.")
            kind = kind[name].dataType
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            raise ValueError(f"{'.'.join(place)!r} holds no list of objects.")
        column = F.col(".".join(f"`{name}`" for name in place))
        rows = documents.select(F.explode(column).alias("_r")).select("_r.*")
    flat = [
        F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else col(f.name)
        for f in rows.schema
    ]
    return rows.select(*flat)
