"""Causal state features and exact-horizon future labels over bars with gaps.

A feature that looks back k bars exists only when k bars of time really elapsed, and a label
at horizon h only when the bar h ahead is h bars of time away. A break in the series can
therefore never fabricate a history, which also makes a bounded halo around each chunk exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.clock import from_micros, local_time, minute_of_session, plus_minutes, MICROS_PER_MINUTE
from barwright.functions.numeric import change, full_frame, ratio
from barwright.operators.sequence import CHUNK, chunk_window, core_rows, with_index_halo, with_row_halo, CORE

TREND_UP, TREND_DOWN, RANGE, UNAVAILABLE = "TREND_UP", "TREND_DOWN", "RANGE", "UNAVAILABLE"


@dataclass(frozen=True)
class FeatureSpec:
    """Window lengths in bars. The defaults are the reference lengths for one-minute bars."""

    minutes: int = 1
    lags: tuple[int, ...] = (1, 5, 15, 30, 60)
    atr: int = 14
    vol_short: int = 15
    vol_long: int = 60
    extreme: int = 60
    momentum: int = 15
    warmup: int = 60
    horizons: tuple[int, ...] = (5, 15, 30, 60)
    point: float = 0.01
    zone: str = "America/Bogota"
    opening_hour: int = 8
    chunk_bars: int = 4096

    @property
    def reach_back(self) -> int:
        return max(*self.lags, self.atr + 1, self.vol_short + 1, self.vol_long + 1, self.extreme, self.warmup)

    @property
    def reach_ahead(self) -> int:
        return max(self.horizons)


ROLLING = ("state_atr", "state_vol_short", "state_vol_long", "state_dist_high", "state_dist_low", "state_momentum")


def add_clock(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Decision time is the close of the bar; session minutes and dates follow the local clock."""
    decision = plus_minutes("ts", spec.minutes)
    local = local_time(decision, spec.zone)
    return df.withColumns({"decision_ts": decision, "local_ts": local.cast("timestamp_ntz"),
                           "minute": minute_of_session(decision, spec.zone, spec.opening_hour),
                           "session_id": F.date_format(local, "yyyy-MM-dd")})


def add_states(df: DataFrame, spec: FeatureSpec, window) -> DataFrame:
    """Past-only features over an ordered window (already chunked by the caller)."""
    index, close = F.col("bar_index"), F.col("close")
    previous = F.lag("close", 1).over(window)

    def rows(n: int):
        return window.rowsBetween(-(n - 1), 0)

    returns = {f"state_return_{k}": F.when(index - F.lag("bar_index", k).over(window) == k,
                                           change(close, F.lag("close", k).over(window))) for k in spec.lags}
    warm = index - F.lag("bar_index", spec.warmup).over(window) == spec.warmup
    df = df.withColumns({
        "_ret1": change(close, previous),
        "_true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)),
        "_warm": F.coalesce(warm, F.lit(False)), **returns})
    high = full_frame(F.max("high"), "high", rows(spec.extreme), spec.extreme)
    low = full_frame(F.min("low"), "low", rows(spec.extreme), spec.extreme)
    rolling = {
        "state_atr": full_frame(F.avg("_true_range"), "_true_range", rows(spec.atr), spec.atr),
        "state_vol_short": full_frame(F.stddev_pop("_ret1"), "_ret1", rows(spec.vol_short), spec.vol_short),
        "state_vol_long": full_frame(F.stddev_pop("_ret1"), "_ret1", rows(spec.vol_long), spec.vol_long),
        "state_dist_high": ratio(high - close, close),
        "state_dist_low": ratio(close - low, close),
        "state_momentum": F.col(f"state_return_{spec.momentum}")}
    df = df.withColumns({name: F.when(F.col("_warm"), value) for name, value in rolling.items()})
    vol, momentum = F.col("state_vol_short"), F.col("state_momentum")
    regime = (F.when(~F.col("_warm"), F.lit(UNAVAILABLE)).when(momentum > vol, F.lit(TREND_UP))
               .when(momentum < -vol, F.lit(TREND_DOWN)).otherwise(F.lit(RANGE)))
    return df.withColumns({
        "state_regime": regime,
        "state_bar_range": F.col("high") - F.col("low"),
        "state_spread_points": F.col("spread").cast("double"),
        "state_spread_price": F.col("spread") * spec.point,
        "state_tick_volume": F.col("tick_volume"),
        "state_real_volume": F.col("real_volume"),
        "state_boundary": F.lit("FEATURES_AVAILABLE_AT_DECISION_TIME"),
        "state_max_source_ts": F.col("ts")}).drop("_warm", "_true_range")


def add_labels(df: DataFrame, spec: FeatureSpec, window) -> DataFrame:
    """Future outcomes at each horizon, NULL unless the horizon is met exactly in elapsed time."""
    close = F.col("close")
    labels = {}
    for h in spec.horizons:
        ahead = window.rowsBetween(1, h)
        exact = F.lead("bar_index", h).over(window) - F.col("bar_index") == h
        high = full_frame(F.max("high"), "high", ahead, h)
        low = full_frame(F.min("low"), "low", ahead, h)
        vol = full_frame(F.stddev_samp("_ret1"), "_ret1", ahead, h) if h > 1 else F.lit(None).cast("double")
        values = {"return": change(F.lead("close", h).over(window), close), "up": ratio(high - close, close),
                  "down": ratio(low - close, close), "vol": vol, "spread": F.lead("spread", h).over(window),
                  "source_ts": F.lead("ts", h).over(window)}
        labels.update({f"label_{name}_{h}": F.when(exact, value) for name, value in values.items()})
    return df.withColumns({**labels, "label_boundary": F.lit("FUTURE_INFORMATION_LABEL_ONLY")})


def build_frame(bars: DataFrame, spec: FeatureSpec, keys: Sequence[str] = ("symbol",), labels: bool = True) -> DataFrame:
    """States and labels for every bar, in one shuffle by (series, chunk)."""
    chunked = with_index_halo(bars, "bar_index", spec.chunk_bars, spec.reach_back, spec.reach_ahead if labels else 0)
    window = chunk_window(keys, ["bar_index"])
    framed = add_states(chunked, spec, window)
    if labels:
        framed = add_labels(framed, spec, window)
    return add_clock(core_rows(framed).drop("_ret1"), spec)


def session_window(df: DataFrame, last_minute: int = 270) -> DataFrame:
    """Decisions inside the research session."""
    return df.where(F.col("minute").between(0, last_minute))


def session_points(df: DataFrame) -> DataFrame:
    """Sessions with their decision times in order. A session is bounded by the bars of one day."""
    return df.groupBy("symbol", "session_id").agg(
        F.count(F.lit(1)).alias("decisions"), F.min("decision_ts").alias("first_decision"),
        F.max("decision_ts").alias("last_decision"),
        F.sort_array(F.collect_list(F.struct("decision_ts", "close"))).alias("points"))


def derived_states(df: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Magnitudes and ratios used by large-move conditions."""
    return df.withColumns({
        **{f"state_abs_return_{k}": F.abs(F.col(f"state_return_{k}")) for k in lags},
        "state_abs_momentum": F.abs(F.col("state_momentum")),
        "state_min_distance": F.least("state_dist_high", "state_dist_low"),
        "state_vol_ratio": ratio("state_vol_short", "state_vol_long"),
        "state_atr_range": ratio("state_atr", "state_bar_range")})


def simple_features(bars: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """First-generation features: row-based frames that shrink at the start of the series."""
    halo = with_row_halo(bars, keys, order, chunk, 14, ["high", "low", "close"])
    w = chunk_window(keys, order)
    previous, close = F.lag("close", 1).over(w), F.col("close")
    df = halo.withColumn("_ret1", change("close", previous)).withColumn("_tr", F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)))
    recent = w.rowsBetween(-5, 0)
    vol = F.when(F.count("_ret1").over(recent) >= 2, F.stddev_pop("_ret1").over(recent))
    df = (df.withColumn("return_1", F.col("_ret1"))
            .withColumn("return_3", change("close", F.lag("close", 3).over(w)))
            .withColumn("return_6", change("close", F.lag("close", 6).over(w)))
            .withColumn("atr_14", F.avg("_tr").over(w.rowsBetween(-13, 0)))
            .withColumn("volatility_6", vol)
            .withColumn("dist_high_12", ratio(F.max("high").over(w.rowsBetween(-11, 0)) - close, close))
            .withColumn("dist_low_12", ratio(close - F.min("low").over(w.rowsBetween(-11, 0)), close)))
    moving, noise = F.col("return_3"), F.col("volatility_6")
    df = df.withColumn("regime", F.when(moving.isNull() | noise.isNull(), F.lit("UNKNOWN"))
                       .when(moving > noise, F.lit(TREND_UP)).when(moving < -noise, F.lit(TREND_DOWN))
                       .otherwise(F.lit(RANGE)))
    return df.where(F.col(CORE)).drop(CHUNK, CORE, "_ret1", "_tr")


def next_bar_outcome(bars: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """Outcome of the next bar in the series, whatever its distance: return, excursions, absolute return."""
    halo = with_row_halo(bars, keys, order, chunk, 1, ["high", "low", "close"], ahead=True)
    w = chunk_window(keys, order)
    out = (halo.withColumn("next_return", change(F.lead("close", 1).over(w), "close"))
               .withColumn("mfe", change(F.lead("high", 1).over(w), "close"))
               .withColumn("mae", change(F.lead("low", 1).over(w), "close")))
    return out.where(F.col(CORE)).drop(CHUNK, CORE).withColumn("next_abs_return", F.abs("next_return"))


def ratio_partition(sessions: DataFrame, session: str, first: float = 0.6, second: float = 0.8) -> DataFrame:
    """Chronological 60/20/20 split over ordered sessions. The session list is one row per day."""
    days = sessions.select(session).distinct()
    ranked = (days.withColumn("_i", F.row_number().over(Window.orderBy(session)) - 1)
                  .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())))
    dev = F.greatest(F.floor(F.col("_n") * first), F.lit(1))
    held = F.least(F.greatest(F.floor(F.col("_n") * second), dev + 1), F.col("_n") - 1)
    too_few = F.raise_error(F.lit("at least three sessions are required")).cast("string")
    return ranked.withColumn("partition", F.when(F.col("_n") < 3, too_few)
                             .when(F.col("_i") < dev, F.lit("DEV")).when(F.col("_i") < held, F.lit("VALIDATION"))
                             .otherwise(F.lit("LOCKED_OOS"))).drop("_i", "_n")


def calendar_partition(df: DataFrame, time: str, policy: Sequence[tuple[str, str, str]], name: str = "partition") -> DataFrame:
    """Half-open calendar intervals; anything else is OUTSIDE."""
    expr = F.lit("OUTSIDE")
    for label, start, end in reversed(list(policy)):
        inside = (F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp"))
        expr = F.when(inside, F.lit(label)).otherwise(expr)
    return df.withColumn(name, expr)


def leakage_violations(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Rows whose feature source reaches the decision, or whose label source does not lie beyond it."""
    late = [F.col(f"label_source_ts_{h}") <= F.col("state_max_source_ts") for h in horizons]
    bad_label = late[0]
    for p in late[1:]:
        bad_label = F.coalesce(bad_label, F.lit(False)) | F.coalesce(p, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(~(F.col("state_max_source_ts") < F.col("decision_ts"))).alias("state_violations"),
                  F.count_if(bad_label).alias("label_violations"))
