"""Sinks: idempotent immutable publication, partitioned Parquet, diagnostic CSV."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.functions.hashing import fingerprint


class PublishConflict(RuntimeError):
    """Different content was published under the same name before."""


def content_identity(df: DataFrame) -> tuple:
    """Row count and order-independent hashes: one aggregate, three numbers to the driver."""
    row = df.agg(*fingerprint(sorted(df.columns))).first()
    return tuple(None if v is None else int(v) for v in row)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_published(spark: SparkSession, path: str) -> bool:
    """A folder counts only with the marker that a finished write leaves."""
    files, place = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write once: the same content again is a no-op, different content is a conflict.

    The rows are written beside the target and moved there when complete; what a failed write left behind is replaced.
    """
    spark = df.sparkSession
    if is_published(spark, path):
        if content_identity(spark.read.parquet(path).select(*df.columns)) == content_identity(df):
            return "UNCHANGED"
        raise PublishConflict(path)
    files, target = _file_system(spark, path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    write_parquet(df, staging, partition_by)
    if files.exists(target):
        files.delete(target, True)
    if not files.rename(_file_system(spark, staging)[1], target):
        raise OSError(f"could not move {staging} to {path}")
    return "PUBLISHED"


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Zstandard Parquet. Before a partitioned write rows gather by partition value plus a salt from the row itself, so that a
    partition with a third of the rows is still written by many tasks, and a repeated task deals alike."""
    if partition_by:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(16))).repartition(*partition_by, "_salt").drop("_salt")
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
