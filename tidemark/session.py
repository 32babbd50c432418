"""Session, table and checkpoint helpers shared by the whole package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def session(cores: str = "*", app: str = "tidemark") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("TIDEMARK_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Deal rows by key over all shuffle partitions.

    For steps that are slow for each byte: Spark would join their small
    partitions, and a few tasks would do all the work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder that driver and executors share.

    A cluster names its place in ``spark.checkpoint.dir``. That setting cannot
    change in a running session; where it is unset the folder lies in the
    warehouse. A warehouse on the driver's own disk is refused unless Spark runs
    within one process: executors elsewhere would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir")
        check_shared(found, spark.conf.get("spark.master", ""))
    return f"{found.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def check_shared(folder: str, master: str) -> None:
    """Raise where ``folder`` is a local path and ``master`` names a cluster."""
    local = folder.startswith("file:") or "://" not in folder
    if local and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {folder} is local, and the master is {master}")


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps start from the files: nothing before is computed twice and a
    lost executor costs only its running tasks. The files stay until
    ``drop_cuts``, as results are read late. ``codec`` is the Parquet
    compression, Spark's own setting if None.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Remove all tables that ``cut`` wrote for this application; call it when results are written or collected."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Remove one table that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
