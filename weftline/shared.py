"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset and the session is local, a temporary folder is made and set; on a
    cluster an unset folder is an error, as a machine-local one would not be shared.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="weftline-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_at(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """As ``written``, partitioned ``by`` columns, with the folder, which ``remove`` takes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written_at`` that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffle files of jobs that are over are deleted only then."""
    gc.collect()
    spark._jvm.System.gc()


def bucketed(df: DataFrame, name: str, column: str, buckets: int, *by: str) -> tuple[DataFrame, str]:
    """As ``written_at``, in buckets by ``column``: grouping or joining by it later shuffles only the other side."""
    spark = df.sparkSession
    path, key = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", f"wl_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).partitionBy(*by).bucketBy(buckets, column).saveAsTable(key)
    return spark.table(key), path


class Scratch:
    """Tables that only one job's steps read: written as ``written`` does, and removed together once they have been read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        got, path = written_at(df, name)
        self.paths.append(path)
        return got

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
