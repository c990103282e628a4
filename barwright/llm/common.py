"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows of one Arrow batch where rows hold whole texts.
TEXT_BATCH = "256"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like `name` that is not taken, in any case of its letters."""
    used = {other.lower() for other in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """Python workers see texts a few hundred at a time, so their memory follows the batch, not the partition."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH)
    return df


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    if any("." in name or "`" in name for name in df.columns):
        # Spark looks the columns up by name here; functions look at their places.
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return small_batches(df).mapInArrow(function, schema)


def batch_of(names: Iterable[str], columns: Iterable[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=list(names))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package where neither their path nor the working folder holds it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), "barwright"), "zip", root, "barwright")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
