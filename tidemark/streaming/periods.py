"""Period totals kept up to date over arriving rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import DAILY, MONTHLY, QUARTERLY, WEEKLY
from tidemark.functions.dates import checked
from tidemark.session import scratch_path

#: Months and quarters differ in length; their key is the first day, and the
#: watermark must exceed the longest of them.
LONGEST = {DAILY: "1 day", WEEKLY: "7 days", MONTHLY: "31 days", QUARTERLY: "92 days"}
#: 1970-01-05 was a Monday.
_WINDOW = {DAILY: ("1 day", "0 days"), WEEKLY: ("7 days", "4 days")}


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def running_totals(
    stream: DataFrame, time: str, target: str, frequency: str, *, keys: Sequence[str] = (), delay: str = "1 day"
) -> DataFrame:
    """keys, period, value, row_count over a stream.

    Daily and weekly periods are tumbling windows: in append mode each leaves
    once, when the watermark has passed its end, which is when it is settled.
    Months and quarters are grouped by their first day.
    """
    checked(frequency)
    moment = F.col(time).cast("timestamp")
    usable = stream.select(*keys, moment.alias("_at"), F.col(target).cast("double").alias("_value"))
    usable = usable.filter(F.col("_at").isNotNull() & F.col("_value").isNotNull()).withWatermark("_at", delay)
    if frequency in _WINDOW:
        width, offset = _WINDOW[frequency]
        grain = F.window("_at", width, startTime=offset).alias("_w")
        summed = usable.groupBy(grain, *keys).agg(F.sum("_value").alias("value"), F.count("*").alias("row_count"))
        return summed.select(*keys, F.col("_w.start").cast("date").alias("period"), "value", "row_count")
    part = "month" if frequency == MONTHLY else "quarter"
    summed = usable.groupBy(F.date_trunc(part, "_at").alias("_p"), *keys).agg(
        F.sum("_value").alias("value"), F.count("*").alias("row_count")
    )
    return summed.select(*keys, F.col("_p").cast("date").alias("period"), "value", "row_count")


def settle_available(totals: DataFrame, *, name: str = "settled") -> DataFrame:
    """Run a stream over what has arrived and give the periods it settled."""
    spark = totals.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    running = (
        totals.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(totals.schema).parquet(path)
