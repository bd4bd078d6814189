"""Tables and queries of a database, read by Spark in parallel."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values ----------------------------------------------------------
WRITE_WORDS = (
    "insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke", "merge", "call",
)
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys", "guest")


def check_query(text: str) -> str:
    """Only one reading statement is let through."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";").strip()
    quoted = re.sub(r"'(?:[^']|'')*'", "''", bare)
    if ";" in quoted:
        raise ValueError("Only a single statement can be imported.")
    if not re.match(r"(?is)^(select|with)\b", quoted):
        raise ValueError("Only a SELECT or WITH statement can be imported.")
    found = [word for word in WRITE_WORDS if re.search(rf"(?i)\b{word}\b", quoted)]
    if found:
        raise ValueError(f"An import only reads; found {', '.join(found)}.")
    return bare


def read_database(
    spark: SparkSession,
    url: str,
    *,
    table: str | None = None,
    query: str | None = None,
    options: dict[str, str] | None = None,
    split_on: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 16,
    limit: int | None = None,
) -> DataFrame:
    """A table or a checked query; ``split_on`` reads it in ranges at once."""
    if (table is None) == (query is None):
        raise ValueError("Name either a table or a query.")
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if split_on:
        if not bounds:
            raise ValueError("A split needs the lowest and highest value of its column.")
        source = table if table is not None else f"({check_query(query)}) imported"
        reader = reader.option("dbtable", source).option("partitionColumn", split_on)
        reader = reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", str(partitions))
    else:
        reader = reader.option("dbtable", table) if table is not None else reader.option("query", check_query(query))
    frame = reader.load()
    return frame if limit is None else frame.limit(limit)


def list_tables(columns: DataFrame, system: Sequence[str] = SYSTEM_SCHEMAS) -> DataFrame:
    """schema, table and its columns, from information_schema.columns."""
    listed = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("ordinal_position").alias("position"),
                F.col("column_name").alias("name"),
                F.col("data_type").alias("type"),
                (F.lower("is_nullable") == "yes").alias("nullable"),
            )
        )
    )
    known = columns.filter(~F.lower("table_schema").isin(list(system)))
    return known.groupBy("table_schema", "table_name").agg(listed.alias("columns"))
