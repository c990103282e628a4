"""Counterfactual actions: every state is valued as WAIT, LONG and SHORT with explicit costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.clock import plus_minutes
from barwright.functions.numeric import ratio
from barwright.operators.asof import forward_asof
from barwright.operators.features import FeatureSpec

WAIT, LONG, SHORT = "WAIT", "LONG", "SHORT"
ACTIONS = (WAIT, LONG, SHORT)
QUOTE_TOLERANCE_MICROS = 60_000_000
SLIPPAGE_STATUS = "UNAVAILABLE_NOT_ASSUMED_ZERO"


def attach_quotes(states: DataFrame, ticks: DataFrame, spec: FeatureSpec, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Entry quote at the decision and exit quotes at each horizon, from one as-of pass over all targets."""
    offsets = [0, *spec.horizons]
    due = states.select(*keys, "bar_index", F.explode(F.array(*[F.lit(h) for h in offsets])).alias("_h"), "decision_ts")
    due = due.withColumn("due", plus_minutes("decision_ts", F.col("_h") * spec.minutes)).drop("decision_ts")
    quotes = forward_asof(due, ticks, keys, "due", "ts", "tick_id", ["bid", "ask"], QUOTE_TOLERANCE_MICROS)
    quoted = due.join(quotes.where("valid"), [*keys, "due"]).groupBy(*keys, "bar_index").agg(
        *[F.max(F.when(F.col("_h") == h, F.struct("bid", "ask"))).alias(f"quote_{h}") for h in offsets])
    return states.join(quoted, [*keys, "bar_index"], "left")


def expand_actions(quoted: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Three rows per state. Net uses real quotes on both ends when present, otherwise the spread proxy."""
    df = quoted.withColumn("action", F.explode(F.array(*[F.lit(a) for a in ACTIONS])))
    action, close = F.col("action"), F.col("close")
    entry = F.col("quote_0")
    paid = close + F.col("state_spread_price")
    outcomes, costs = {}, {}
    for h in spec.horizons:
        gross, leave = F.col(f"label_return_{h}"), F.col(f"quote_{h}")
        target = close * (1 + gross)
        long_proxy = ratio(target - paid, paid)
        short_proxy = ratio(close - (target + F.col(f"label_spread_{h}") * spec.point), close)
        real = entry.isNotNull() & leave.isNotNull()
        long_real = ratio(leave["bid"] - entry["ask"], entry["ask"])
        short_real = ratio(entry["bid"] - leave["ask"], entry["bid"])
        zero = F.when(gross.isNotNull(), F.lit(0.0))

        def by_action(long: Column, short: Column, wait: Column) -> Column:
            return F.when(action == LONG, long).when(action == SHORT, short).otherwise(wait)

        net = by_action(F.when(real, long_real).otherwise(long_proxy), F.when(real, short_real).otherwise(short_proxy), F.lit(0.0))
        outcomes.update({
            f"gross_{h}": by_action(gross, -gross, zero),
            f"net_{h}": F.when(gross.isNotNull(), net),
            f"mfe_{h}": by_action(F.col(f"label_up_{h}"), -F.col(f"label_down_{h}"), zero),
            f"mae_{h}": by_action(F.col(f"label_down_{h}"), -F.col(f"label_up_{h}"), zero),
            f"cost_method_{h}": F.when(action == WAIT, F.lit("NO_POSITION"))
                                 .when(real, F.lit("REAL_TICK_COST")).otherwise(F.lit("PROXY_COST"))})
        costs[f"cost_{h}"] = F.col(f"gross_{h}") - F.col(f"net_{h}")
    return (df.withColumns(outcomes).withColumns({
        **costs, "counterfactual": F.lit(True), "execution_real": F.lit(False),
        "estimated_slippage": F.lit(None).cast("double"), "slippage_status": F.lit(SLIPPAGE_STATUS)})
        .drop(*[f"quote_{h}" for h in [0, *spec.horizons]]))


def unpivot_horizons(experiences: DataFrame, keep: Sequence[str], horizons: Sequence[int],
                     fields: Sequence[str] = ("gross", "net", "mfe", "mae", "cost", "cost_method")) -> DataFrame:
    """Long form: one row per experience and horizon."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{f}_{h}").alias(f) for f in fields]) for h in horizons])
    return experiences.select(*keep, F.inline(rows))


def with_identity(experiences: DataFrame, version: str) -> DataFrame:
    """Deterministic id from dataset version, session, decision time and action."""
    stamp = F.date_format("decision_ts", "yyyyMMddHHmmss")
    return experiences.withColumn("experience_id", F.sha2(F.concat_ws("|", F.lit(version), "session_id", stamp, "action"), 256))


def identity_conflicts(experiences: DataFrame) -> DataFrame:
    """Ids claimed by more than one row; must be empty."""
    return experiences.groupBy("experience_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def cost_simple(df: DataFrame) -> DataFrame:
    """Bar-spread cost of an action with its provenance; an absent spread stays unavailable."""
    spread, wait = F.col("spread_price"), F.col("action") == WAIT
    return (df.withColumn("method", F.when(wait, F.lit("NO_POSITION")).when(spread.isNull(), F.lit("UNAVAILABLE"))
                          .otherwise(F.lit("BAR_SPREAD_APPROXIMATION")))
              .withColumn("round_trip_return", F.when(wait, F.lit(0.0)).otherwise(ratio(spread, "close")))
              .withColumn("quality", F.when(wait, F.lit("EXACT")).when(spread.isNull(), F.lit("NOT_COMPUTABLE_WITHOUT_BID_ASK_OR_BAR_SPREAD"))
                          .otherwise(F.lit("APPROXIMATION"))))


def cost_layered(df: DataFrame) -> DataFrame:
    """A real quote wins over the spread proxy; missing slippage is a status, never zero."""
    real, spread = F.col("real_tick_cost"), F.col("spread_price")
    proxy = ratio(spread, "close")
    return (df.withColumn("method", F.when(real.isNotNull(), F.lit("REAL_TICK_COST")).when(spread.isNotNull(), F.lit("PROXY_COST"))
                          .otherwise(F.lit("UNAVAILABLE")))
              .withColumn("round_trip_return", F.coalesce(real, proxy))
              .withColumn("confidence", F.when(real.isNotNull(), F.lit("HIGH")).when(spread.isNotNull(), F.lit("MEDIUM")).otherwise(F.lit("LOW")))
              .withColumn("slippage_status", F.when(F.col("estimated_slippage").isNotNull(), F.lit("AVAILABLE")).otherwise(F.lit(SLIPPAGE_STATUS))))
