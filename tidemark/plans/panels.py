"""Panels the registered queries start from, in Spark and as SQL text.

Facts are aggregated to their foreign key and period before any dimension is
joined: the join then sees one row per key and period, so a key that holds a
third of the fact rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import DAILY, KEY_SEPARATOR, MONTHLY, QUARTERLY, WEEKLY
from tidemark.functions.dates import period_start
from tidemark.plans.catalog import table

PARTS = {DAILY: "day", WEEKLY: "week", MONTHLY: "month", QUARTERLY: "quarter"}


def trunc_sql(column: str, frequency: str) -> str:
    return f"CAST(date_trunc('{PARTS[frequency]}', {column}) AS DATE)"


def key_cells(spark: SparkSession, folder: str, key: str, frequency: str, measure: str) -> DataFrame:
    """key, period, value, row_count: lineitem summed to one of its keys."""
    rows = table(spark, folder, "lineitem").select(
        F.col(key), period_start(F.col("l_shipdate").cast("date"), frequency).alias("period"), F.col(measure)
    )
    return rows.groupBy(key, "period").agg(F.sum(measure).alias("value"), F.count("*").alias("row_count"))


def supplier_cells(
    spark: SparkSession, folder: str, frequency: str = MONTHLY, measure: str = "l_extendedprice"
) -> DataFrame:
    """region, nation, supplier, period, value, row_count: suppliers of one name in one nation count as one."""
    cells = key_cells(spark, folder, "l_suppkey", frequency, measure)
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    placed = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    named = cells.join(placed, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("s_name").alias("supplier"),
        "period",
        "value",
        "row_count",
    )
    return named.groupBy("region", "nation", "supplier", "period").agg(
        F.sum("value").alias("value"), F.sum("row_count").alias("row_count")
    )


def supplier_cells_sql(frequency: str = MONTHLY, measure: str = "l_extendedprice") -> str:
    return f"""SELECT r_name AS region, n_name AS nation, s_name AS supplier,
        {trunc_sql('l_shipdate', frequency)} AS period, SUM({measure}) AS value, COUNT(*) AS row_count
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      GROUP BY ALL"""


def supplier_panel(
    spark: SparkSession, folder: str, frequency: str = MONTHLY, measure: str = "l_extendedprice"
) -> DataFrame:
    """series_id, ds, y: one series per supplier."""
    cells = supplier_cells(spark, folder, frequency, measure)
    label = F.concat_ws(KEY_SEPARATOR, "region", "nation", "supplier")
    return cells.select(label.alias("series_id"), F.col("period").alias("ds"), F.col("value").alias("y"))


def supplier_panel_sql(frequency: str = MONTHLY, measure: str = "l_extendedprice") -> str:
    return f"""SELECT region || ' · ' || nation || ' · ' || supplier AS series_id, period AS ds, value AS y
      FROM ({supplier_cells_sql(frequency, measure)})"""


def part_panel(
    spark: SparkSession, folder: str, frequency: str = MONTHLY, measure: str = "l_quantity"
) -> DataFrame:
    """series_id, ds, y: one sparse series per part."""
    cells = key_cells(spark, folder, "l_partkey", frequency, measure)
    return cells.select(
        F.col("l_partkey").cast("string").alias("series_id"),
        F.col("period").alias("ds"),
        F.col("value").alias("y"),
    )


def part_panel_sql(frequency: str = MONTHLY, measure: str = "l_quantity") -> str:
    return f"""SELECT CAST(l_partkey AS VARCHAR) AS series_id, {trunc_sql('l_shipdate', frequency)} AS ds,
        SUM({measure}) AS y FROM lineitem GROUP BY ALL"""


def aligned_sql(panel: str, frequency: str) -> str:
    """CTEs ``panel`` and ``aligned`` (series_id, t, n, ds, y) for a panel query."""
    step = {DAILY: "1 DAY", WEEKLY: "7 DAY", MONTHLY: "1 MONTH", QUARTERLY: "3 MONTH"}[frequency]
    return f"""panel AS ({panel}),
    grid AS (
      SELECT series_id, CAST(unnest(generate_series(MIN(ds), MAX(ds), INTERVAL {step})) AS DATE) AS ds
      FROM panel GROUP BY series_id),
    aligned AS (
      SELECT grid.series_id, row_number() OVER (PARTITION BY grid.series_id ORDER BY grid.ds) - 1 AS t,
        COUNT(*) OVER (PARTITION BY grid.series_id) AS n, grid.ds, panel.y
      FROM grid LEFT JOIN panel USING (series_id, ds))"""
