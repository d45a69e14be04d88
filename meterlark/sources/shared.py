"""Folders that the driver and all executors share, and which of their numbered parts are whole."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files go when it ends; otherwise they stay until the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a temporary folder, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meterlark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a write of this folder came to its end."""
    files, place = _place(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def parts(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the whole folders path/name=N, in order."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return []
    found = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    numbers = sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}="))
    return [n for n in numbers if whole(spark, f"{path}/{name}={n}")]


def removed(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder's Parquet files; a folder that isn't there yet is an empty table.  Partition columns are told by the schema."""
    files, place = _place(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(place) else spark.createDataFrame([], schema)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def kept(df: DataFrame, key: str, shares: int, path: str) -> DataFrame:
    """The whole table written to a folder, one share of its keys after another, and read from there: of shuffle files only a share's are on disk at a time.

    The filter of a share reaches the scans where rows are grouped and joined by the key.
    """
    with shuffles_freed(df.sparkSession):
        for i in range(shares):
            share = df if shares == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(shares)) == i)
            share.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
