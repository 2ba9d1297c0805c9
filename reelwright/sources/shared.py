"""Folders that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def folder_of(spark: SparkSession) -> str:
    """A new folder in the application's own one, which stands in the one that spark.checkpoint.dir names (where that is unset, in the
    warehouse: on a cluster that must be shared, too) and goes when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{named.rstrip('/')}/reelwright-containers-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if named == spark.conf.get("spark.sql.warehouse.dir") and system.getUri().getScheme() == "file" and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders[sc.applicationId] = folder
    return f"{_folders[sc.applicationId]}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a table in a shared folder: what reads it several times, or grows from it, starts there."""
    path = folder_of(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df in tasks of about so many rows, one a core at least, by key: for work that takes long beside the bytes that it reads, by which
    Spark counts out tasks."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)
