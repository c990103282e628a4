"""Session construction and the settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "barwright", cores: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the semantics depend on: UTC clock, ANSI arithmetic, and stored times whose footers hold statistics."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts. The cluster names it; a private one is made only in local mode, as in tests."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a derived table that several later steps read.

    A reliable checkpoint in the shared folder: the table is computed once, survives lost executors, and
    the plans built on it stay small instead of doubling with every reference.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
