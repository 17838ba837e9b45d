"""Session settings, table reading, and cutting of lineage through the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings an engine session starts with; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass your own session to the operators instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("folioweave")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", driver_memory).config("spark.sql.shuffle.partitions", shuffle_partitions)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` (a file or a folder) of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where none is set a local run makes a temporary one, and a
    cluster raises RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="folioweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Hadoop deletes it when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/folioweave-{os.getpid()}-{uuid.uuid4().hex[:12]}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    named = files.makeQualified(folder).toString()  # with the scheme that readers outside the JVM need
    return f"{named.replace('file:/', 'file:///', 1) if named.startswith('file:/') and not named.startswith('file://') else named}/{name}"


def cut(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a parquet table in the shared folder and reads it back: cuts lineage, survives the loss of executors,
    and costs less disk than checkpoint(), which stores rows uncompressed."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.cut_path = path
    return stored


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, for joins of tables that both grow with the input: it is merged after a shuffle and never broadcast. Spark takes
    the size of a table from its compressed files, also where its rows were exploded after, and so would send to the
    driver what has a hundred times the bytes it expects. The hint holds up to the first join."""
    return df.hint("merge")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """`cut` for tables that grow with the questions: its first join is `by_shuffle`, and the shuffle files that wrote it go
    at once instead of when the driver happens to collect its garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return by_shuffle(cut(df, name))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def forget(stored: DataFrame) -> None:
    """Deletes a table of `cut` that nothing will read again, as a loop's last round."""
    path = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.cut_path)
    path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
