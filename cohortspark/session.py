"""Session helpers: local sessions for tests and the shared folder for cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local session
    without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named is None and current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="cohortspark-")
    if current is None:
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Evaluate once: write a table to the shared folder and read it back.

    Later plans start from the written table, whichever executors are lost.
    ``partition_by`` lays rows out in one folder per value of a column with
    few values, so that filters on it skip folders. The table is removed when the
    application ends.
    """
    path = shared_path(df.sparkSession, "cut")
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    jvm = df.sparkSession.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
