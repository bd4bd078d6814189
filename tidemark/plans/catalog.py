"""Registry of named queries and the output shape each one promises.

A query names its output columns with a type after a colon: ``date``, ``str``,
``int``, ``bool`` or a number of decimals for a double. The same shape is put
on the Spark result and on the SQL text, so the two can be compared by value.
Dates leave as ISO text, which reads the same from every engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import col

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


CATALOG: dict[str, Query] = {}


def _fields(columns: str) -> list[tuple[str, str]]:
    return [tuple(field.split(":")) for field in columns.split()]


def _nudge(decimals: str) -> float:
    """Moves exact halves off the rounding edge, where the last bit of a sum
    (engines add in different orders) would decide. Adding zero afterwards
    turns a negative zero into a plain one."""
    return float(f"3.7e-{int(decimals) + 4}")


def shape(frame: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _fields(columns):
        value = col(name)
        if kind in ("date", "str"):
            value = value.cast("string")
        elif kind == "int":
            value = value.cast("bigint")
        elif kind == "bool":
            value = value.cast("boolean")
        else:
            value = F.round(value.cast("double") + F.lit(_nudge(kind)), int(kind)) + F.lit(0.0)
        out.append(value.alias(name))
    return frame.select(*out)


def shape_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _fields(columns):
        quoted = f'"{name}"'
        if kind == "date":
            value = f"CAST(CAST({quoted} AS DATE) AS VARCHAR)"
        elif kind == "str":
            value = f"CAST({quoted} AS VARCHAR)"
        elif kind == "int":
            value = f"CAST({quoted} AS BIGINT)"
        elif kind == "bool":
            value = f"CAST({quoted} AS BOOLEAN)"
        else:
            value = f"round(CAST({quoted} AS DOUBLE) + {_nudge(kind)!r}::DOUBLE, {kind}) + 0.0"
        out.append(f"{value} AS {quoted}")
    return f"SELECT {', '.join(out)} FROM (\n{sql.strip()}\n) AS result"


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query; without SQL it is checked by its own tests only."""

    def register(run: Runner) -> Runner:
        if name in CATALOG:
            raise ValueError(f"Query {name} is registered twice.")

        def shaped(spark: SparkSession, folder: str) -> DataFrame:
            return shape(run(spark, folder), columns)

        CATALOG[name] = Query(shaped, None if sql is None else shape_sql(sql, columns))
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
