"""Bindings of the generic operators to the driver tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.functions.numeric import rounded
from barwright.session import ensure_checkpoint_dir
from barwright.operators.features import FeatureSpec, build_frame
from barwright.sources import sinks
from barwright.sources.bars import build_bars

POINT = 0.01
# Reference window lengths on hourly bars.
HOURLY = FeatureSpec(minutes=60)
# Short windows on quarter-hour bars, where the small tables still have contiguous stretches.
QUARTER = FeatureSpec(minutes=15, lags=(1, 3, 5, 10, 15), atr=5, vol_short=5, vol_long=10, extreme=10, momentum=5,
                      warmup=10, horizons=(1, 3, 5, 10))


class Tables:
    """Lazy access to the tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str, build, partition_by: Sequence[str] = ()) -> DataFrame:
        """A derived table, published as Parquet in the shared folder of this application on first use and read from there.

        Readers prune its columns and push their filters into its scan; a half-written table does not count as published.
        """
        path = self.stored_path(name)
        if not sinks.is_published(self.spark, path):
            sinks.publish(build(), path, partition_by)
        return self.spark.read.parquet(path)

    def stored_path(self, name: str) -> str:
        # One folder per application and table directory: no run reads what another made of other data.
        root, source = ensure_checkpoint_dir(self.spark).rstrip("/"), hashlib.md5(self.dir.encode()).hexdigest()[:12]
        return f"{root}/stored/{self.spark.sparkContext.applicationId}/{source}/{name}"

    @cached_property
    def events(self) -> DataFrame:
        raw = self.read("events")
        return raw.withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def ticks(self) -> DataFrame:
        """Events as two-sided quotes: the value is the bid, the props counter the spread in points."""
        points = F.get_json_object("props", "$.k").cast("double")
        return self.events.select(
            F.lit("EVT").alias("symbol"), F.col("event_id").alias("tick_id"), "ts", F.col("value").alias("bid"),
            (F.col("value") + points * POINT).alias("ask"), points.alias("points"))

    def bars(self, minutes: int) -> DataFrame:
        return build_bars(self.events, minutes, time="ts", value="value", tiebreak="event_id",
                          spread=F.get_json_object("props", "$.k"), actor="user_id", symbol=F.lit("EVT"))

    def frame(self, spec: FeatureSpec, labels: bool = True) -> DataFrame:
        return build_frame(self.bars(spec.minutes), spec, labels=labels)


def day_chunk(time: str = "ts", days: int = 7) -> Column:
    """Calendar chunk for row-counted frames: as many chunks as the span has weeks."""
    return F.floor(F.unix_micros(time) / F.lit(days * 86_400_000_000)).cast("bigint")


def rounded_all(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])
