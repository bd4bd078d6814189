"""Stored tables: columnar writes, append-only results, exports, one registry."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.database import read_database
from tidemark.sources.delimited import read_delimited
from tidemark.sources.records import read_records


def write_table(frame: DataFrame, path: str, *, by: tuple[str, ...] = ()) -> None:
    """Typed Parquet, so that later filters and projections reach the scan."""
    writer = frame.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footers; no rows are read."""
    return read_table(spark, path).columns


def reach_of(spark: SparkSession, path: str, column: str) -> object:
    """The largest value of a column: from the footers where the type has exact
    statistics there, otherwise from that column alone."""
    # A session of its own, so that the caller's settings stay as they are.
    quiet = spark.newSession()
    quiet.conf.set("spark.sql.sources.useV1SourceList", "")
    quiet.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return quiet.read.parquet(path).agg(F.max(column)).first()[0]


def fitting_sources(spark: SparkSession, tables: Mapping[str, str], needed: Sequence[str], time: str, start: object) -> list[str]:
    """Names of the tables (name to path) that have every needed column and reach
    ``start`` or beyond. Columns and reach come from the footers: no candidate is
    read for them. ``start`` is a day, or what the column's own values compare with."""
    fitting = []
    for name, path in tables.items():
        if not set(needed) | {time} <= set(columns_of(spark, path)):
            continue
        reach = reach_of(spark, path, time)
        reach = reach.date() if isinstance(reach, datetime) and not isinstance(start, datetime) else reach
        if reach is not None and reach >= start:
            fitting.append(name)
    return fitting


def append_run(frame: DataFrame, path: str, key: str = "run_id") -> None:
    """Add a run's rows to a result table; what was issued is never rewritten."""
    spark = frame.sparkSession
    try:
        held = spark.read.parquet(path)
    except AnalysisException:
        held = None
    if held is not None and not frame.join(held.select(key).distinct(), key, "left_semi").isEmpty():
        raise ValueError(f"Rows for this {key} were issued before and cannot be written again.")
    frame.write.mode("append").option("compression", "zstd").partitionBy(key).parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def _manifest(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/run_id={run_id}/_manifest.json"


def issue_run(tables: Mapping[str, DataFrame], path: str, run_id: str) -> str:
    """Store all tables of a run under a folder of this attempt's own, and publish
    them by one manifest, written last. Readers go by manifests, so a run is seen
    whole or not at all. Of two writers of one run the first to publish passes and
    the other is refused. Returns the attempt's name."""
    if not tables or not run_id or any(mark in run_id for mark in "/=\\"):
        raise ValueError("A run needs tables, and an id that can name a folder.")
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    files, manifest = _files(spark, _manifest(path, run_id))
    if files.exists(manifest):
        raise ValueError(f"Run {run_id} was issued before and cannot be written again.")
    attempt = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/run_id={run_id}/attempt={attempt}"
    for name, frame in tables.items():
        write_table(frame, f"{folder}/table={name}")
    _, draft = _files(spark, f"{folder}/_draft.json")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"run_id": run_id, "attempt": attempt, "tables": sorted(tables)}).encode()))
    out.close()
    # This rename refuses a target that exists.
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(manifest), spark.sparkContext._gateway.new_array(rename, 0))
    except Py4JJavaError as error:
        if files.exists(manifest):
            raise ValueError(f"Run {run_id} was issued before and cannot be written again.") from error
        raise
    return attempt


def issued_runs(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of all runs that were issued: run_id, attempt, tables."""
    files, pattern = _files(spark, _manifest(path, "*"))
    found = files.globStatus(pattern) or []
    return sorted((json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(files.open(one.getPath()), "UTF-8")) for one in found), key=lambda held: held["run_id"])


def read_run(spark: SparkSession, path: str, name: str, run_ids: Sequence[str] | None = None) -> DataFrame:
    """One table of the issued runs, all or those named, with their run_id."""
    held = [one for one in issued_runs(spark, path) if name in one["tables"] and (run_ids is None or one["run_id"] in run_ids)]
    if not held:
        raise ValueError(f"No issued run has a table {name}.")
    base = path.rstrip("/")
    frame = None
    for one in held:
        own = spark.read.parquet(f"{base}/run_id={one['run_id']}/attempt={one['attempt']}/table={name}").withColumn("run_id", F.lit(one["run_id"]))
        frame = own if frame is None else frame.unionByName(own, allowMissingColumns=True)
    return frame


def export_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("header", True).csv(path)


#: Readers by the name of what they read.
READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_delimited,
    "tsv": lambda spark, path, **options: read_delimited(spark, path, delimiter="\t", **options),
    "json": read_records,
    "jdbc": read_database,
    "parquet": read_table,
}


def read_source(spark: SparkSession, kind: str, location: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"No source of type {kind!r}; known are {', '.join(READERS)}.")
    return READERS[kind](spark, location, **options)
