"""Session factory and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lotwerk")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, else, in local mode only, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(spark, "_lotwerk_folder", None) or "file://" + tempfile.mkdtemp(prefix="lotwerk-")
        spark._lotwerk_folder = folder
    return folder.rstrip("/")


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and return the table: a lineage cut that survives lost executors.

    partition_by: the column whose values are folders of the table; it must be the last of df.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lotwerk/{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lotwerk_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_lotwerk_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have what nothing refers to any more collected: Spark deletes shuffle files and broadcasts when the driver's objects for
    them are, and a driver with room left may not do so for long. For use between the large steps of one query."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all tables that cut() wrote to the shared folder; for the end of a pipeline, when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lotwerk")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
