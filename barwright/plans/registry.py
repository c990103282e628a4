"""Named queries over the driver tables, each with its comparison SQL where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barwright.session import prepare

MODULES = ("quality", "diagnostics", "features", "store", "evidence", "stability", "verdicts", "campaigns", "opportunities", "learning", "knowledge", "custody")


@dataclass
class Registry:
    builders: dict[str, Callable] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def wrap(builder):
            if name in self.builders:
                raise ValueError(f"duplicate query {name}")
            self.builders[name] = builder
            if sql is not None:
                self.sql[name] = sql
            return builder
        return wrap


REGISTRY = Registry()
query = REGISTRY.add


def load_all() -> Registry:
    for module in MODULES:
        importlib.import_module(f"barwright.plans.{module}")
    return REGISTRY


def as_output(df: DataFrame) -> DataFrame:
    """Zone-free timestamps for consumers that compare plain clock readings."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def runnable(builder: Callable) -> Callable[[SparkSession, str], DataFrame]:
    from barwright.plans.bindings import Tables

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_output(builder(Tables(prepare(spark), sf_dir)))
    run.__doc__ = builder.__doc__
    return run
