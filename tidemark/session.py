"""Session settings the library relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a session should carry. Sizes of partitions are left to adaptive
#: execution, which also splits skewed join partitions and switches a join to
#: broadcast only once it has measured the small side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: One BLAS thread per Python worker: Spark already runs one worker per core.
WORKER_THREADS = {
    f"spark.executorEnv.{name}": "1"
    for name in (
        "OMP_NUM_THREADS",
        "OPENBLAS_NUM_THREADS",
        "MKL_NUM_THREADS",
        "NUMEXPR_NUM_THREADS",
        "VECLIB_MAXIMUM_THREADS",
    )
}


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in {**SETTINGS, **WORKER_THREADS}.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Folders that stand in where a local session names none; gone at exit.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own that goes when
    the process ends, and any other a folder below the shared warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if context.applicationId not in _OWN:
        made = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _OWN[context.applicationId] = made
    return _OWN[context.applicationId]


def run_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has written there; call it when no result
    that was cut from its lineage is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(frame: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where one result feeds several branches or a loop: the work is done
    once and survives the loss of any executor.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
