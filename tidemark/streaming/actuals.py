"""Readings into the log of actuals, batch by batch.

Every reading is kept: whether it changes anything depends on what was reported
before it, and that may still arrive. Each batch writes its own folder, so a
batch run again after a failure replaces what it wrote before, and no batch
reads the log. What changed, and when, is worked out from all readings, so it
does not depend on how they fell into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import scratch_path

_SCHEMA = "series_key string, target_date date, value double, revised_at timestamp"


def append_readings(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write the readings of a batch, repeats once."""
    rows = batch.select("series_key", "target_date", "value", "revised_at").distinct()
    rows.write.mode("overwrite").parquet(f"{path}/batch-{batch_id:012d}")


def changes(readings: DataFrame) -> DataFrame:
    """Readings that differ from the one in force at their own moment.

    A late reading is held against its predecessor by time of report, and so is
    the one that follows it.
    """
    order = Window.partitionBy("series_key", "target_date").orderBy("revised_at", "value")
    marked = readings.select("series_key", "target_date", "value", "revised_at").distinct().select(
        "*", F.lag("value").over(order).alias("_before"), F.row_number().over(order).alias("_place")
    )
    kept = marked.filter((F.col("_place") == 1) | ~F.col("value").eqNullSafe(F.col("_before")))
    return kept.drop("_before", "_place")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of changes from all batches written so far."""
    # An empty part keeps the folder readable before the first batch.
    spark.createDataFrame([], _SCHEMA).write.mode("append").parquet(path)
    return changes(spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(path))


def ingest_available(readings: DataFrame, *, name: str = "actuals") -> DataFrame:
    """Run a stream of readings over what has arrived and give the log."""
    spark = readings.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    running = (
        readings.writeStream.foreachBatch(lambda batch, batch_id: append_readings(batch, batch_id, path))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return read_log(spark, path)
