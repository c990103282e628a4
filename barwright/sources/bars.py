"""Bars of any timeframe from a stream of point observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.clock import MICROS_PER_MINUTE, bar_index, from_micros
from barwright.functions.numeric import col


def build_bars(df: DataFrame, minutes: int, *, time: str, value: str, tiebreak: str, spread: Column,
               actor: str, symbol: Column) -> DataFrame:
    """Open/high/low/close bars with observation counts, distinct actors and the closing spread.

    The distinct count is taken in two steps, so a bar that holds a third of all rows is still
    counted by partial aggregates.
    """
    order = F.struct(F.col(time), F.col(tiebreak))
    slots = df.select(symbol.alias("symbol"), bar_index(time, minutes).alias("bar_index"), F.col(actor).alias("_actor"),
                      F.col(value).alias("_v"), order.alias("_o"), spread.cast("double").alias("_s"))
    per_actor = slots.groupBy("symbol", "bar_index", "_actor").agg(
        F.min(F.struct("_o", "_v")).alias("_first"), F.max(F.struct("_o", "_v", "_s")).alias("_last"),
        F.max("_v").alias("_high"), F.min("_v").alias("_low"), F.count(F.lit(1)).alias("_n"))
    bars = per_actor.groupBy("symbol", "bar_index").agg(
        F.min("_first")["_v"].alias("open"), F.max("_high").alias("high"), F.min("_low").alias("low"),
        F.max("_last")["_v"].alias("close"), F.sum("_n").cast("double").alias("tick_volume"),
        F.max("_last")["_s"].alias("spread"), F.count("_actor").cast("double").alias("real_volume"))
    return bars.select("symbol", "bar_index", from_micros(F.col("bar_index") * (minutes * MICROS_PER_MINUTE)).alias("ts"),
                       "open", "high", "low", "close", "tick_volume", "spread", "real_volume")


def normalize_feed(df: DataFrame, *, symbol="symbol", time="ts") -> DataFrame:
    """Upper-case symbols, absent spread and real volume as NULL, UTC clock, ordered output."""
    have = set(df.columns)
    optional = [(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in ("spread", "real_volume")]
    return df.select(F.upper(col(symbol)).alias("symbol"), col(time).cast("timestamp").alias("ts"),
                     *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "tick_volume")],
                     *optional)
