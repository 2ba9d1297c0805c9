"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_folders: dict[str, str] = {}


def _hadoop_path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that spark.checkpoint.dir names (where that is unset, as in tests: in the warehouse, which all
    executors see as well). It goes when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{named.rstrip('/')}/reelwright-{sc.applicationId}"
        system, path = _hadoop_path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders[sc.applicationId] = folder
    return _folders[sc.applicationId]


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has ended; whatever reads its result reads a table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def cut(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table to the shared folder and read again: a reliable and compact cut of lineage."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    with _shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table behind a df that cut() gave and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        system, path = _hadoop_path(df.sparkSession, folder)
        system.delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new folder in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that name, whatever marks it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that to ASCII texts and is faster than translate()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, A_TO_Z, A_TO_Z.lower()))


def hash48(text: Column) -> Column:
    """A number in 0 .. 2^48-1 from a string's MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0: rows no model may learn from. A null id counts as empty text (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, key: Column, n: int, salt: str = "") -> DataFrame:
    """About n rows of df, chosen by the hash of their key, the same ones at every run; of more than 2 n (a key that repeats) those that
    come first by the hashes of key and row."""
    total = df.count()
    if total <= n:
        return df
    h = hash48(F.concat(key.cast("string"), F.lit("~" + salt)))
    return df.filter(h < F.lit(int((1 << 48) * n / total))).orderBy(h, F.xxhash64(*df.columns)).limit(2 * n)
