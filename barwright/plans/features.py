"""Feature, label, session and action queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barwright.functions.numeric import rounded
from barwright.operators import actions as A, features as X
from barwright.operators.asof import forward_asof, potential_slippage
from barwright.plans import oracle
from barwright.plans.bindings import HOURLY, POINT, QUARTER, Tables, day_chunk, rounded_all
from barwright.plans.quality import TICKS_SQL
from barwright.plans.registry import query

HSQL = oracle.bars(60) + oracle.states(HOURLY)
QSQL = oracle.bars(15) + oracle.states(QUARTER)
POLICY = (("DEV", "2024-01-01 00:00:00", "2024-01-17 00:00:00"), ("VALIDATION", "2024-01-17 00:00:00", "2024-01-23 00:00:00"),
          ("LOCKED_OOS", "2024-01-23 00:00:00", "2024-01-29 00:00:00"))


def _columns(name: str, exact: list[str], doubles: list[str], labels: bool = False):
    sql = HSQL + f" SELECT {', '.join(['ts'] + exact + [f'{oracle.r(c)} AS {c}' for c in doubles])} FROM states"

    @query(name, sql)
    def build(t: Tables) -> DataFrame:
        f = t.frame(HOURLY, labels=labels)
        return f.select("ts", *exact, *[rounded(c).alias(c) for c in doubles])
    return build


_columns("f01_decision_clock", ["decision_ts", "local_ts", "minute", "session_id"], [])
_columns("f02_lagged_returns", [], [f"state_return_{k}" for k in HOURLY.lags])
_columns("f03_range_and_atr", [], ["state_bar_range", "state_atr"])
_columns("f04_causal_volatility", [], ["state_vol_short", "state_vol_long"])
_columns("f05_extreme_distance", [], ["state_dist_high", "state_dist_low"])
_columns("f06_regime", ["state_regime"], ["state_momentum"])
_columns("f08_cost_and_boundary", ["state_max_source_ts"], ["state_spread_points", "state_spread_price", "state_tick_volume", "state_real_volume"])
_columns("f09_future_return", [], [f"label_return_{h}" for h in HOURLY.horizons], True)
_columns("f10_future_excursions", [], [f"label_{s}_{h}" for s in ("up", "down") for h in HOURLY.horizons], True)
_columns("f11_future_volatility", [], [f"label_vol_{h}" for h in HOURLY.horizons], True)
_columns("f12_future_spread", [f"label_source_ts_{h}" for h in HOURLY.horizons], [f"label_spread_{h}" for h in HOURLY.horizons], True)


@query("f07_warmup_mask", HSQL + " SELECT count(*) AS bars, count(*) FILTER (warm) AS warm_bars, count(state_atr) AS with_atr, count(state_vol_long) AS with_vol, count(state_dist_low) AS with_extremes FROM states")
def warmup(t: Tables) -> DataFrame:
    f = t.frame(HOURLY, labels=False)
    return f.agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("state_regime") != X.UNAVAILABLE).alias("warm_bars"),
                 F.count("state_atr").alias("with_atr"), F.count("state_vol_long").alias("with_vol"), F.count("state_dist_low").alias("with_extremes"))


@query("f13_session_window", QSQL + " SELECT ts, session_id, minute FROM states WHERE minute BETWEEN 0 AND 270")
def session_window(t: Tables) -> DataFrame:
    return X.session_window(t.frame(QUARTER, labels=False)).select("ts", "session_id", "minute")


@query("f14_session_points", QSQL + f""" SELECT session_id, count(*) AS decisions, min(decision_ts) AS first_decision, max(decision_ts) AS last_decision,
  {oracle.r('arg_min(close, decision_ts)')} AS first_close, {oracle.r('arg_max(close, decision_ts)')} AS last_close FROM states WHERE minute BETWEEN 0 AND 270 GROUP BY session_id""")
def session_points(t: Tables) -> DataFrame:
    s = X.session_points(X.session_window(t.frame(QUARTER, labels=False)))
    return s.select("session_id", "decisions", "first_decision", "last_decision", rounded(F.element_at("points", 1)["close"]).alias("first_close"),
                    rounded(F.element_at("points", -1)["close"]).alias("last_close"))


SIMPLE = ["return_1", "return_3", "return_6", "atr_14", "volatility_6", "dist_high_12", "dist_low_12"]


@query("f15_simple_features", oracle.bars(60) + f""", a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS return_1, close / nullif(lag(close, 3) OVER w, 0) - 1 AS return_3,
  close / nullif(lag(close, 6) OVER w, 0) - 1 AS return_6, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (ORDER BY ts)),
b AS (SELECT *, avg(tr) OVER (ORDER BY ts ROWS 13 PRECEDING) AS atr_14,
  CASE WHEN count(return_1) OVER (ORDER BY ts ROWS 5 PRECEDING) >= 2 THEN stddev_pop(return_1) OVER (ORDER BY ts ROWS 5 PRECEDING) END AS volatility_6,
  (max(high) OVER (ORDER BY ts ROWS 11 PRECEDING) - close) / nullif(close, 0) AS dist_high_12, (close - min(low) OVER (ORDER BY ts ROWS 11 PRECEDING)) / nullif(close, 0) AS dist_low_12 FROM a)
SELECT ts, {oracle.rs(SIMPLE)}, CASE WHEN return_3 IS NULL OR volatility_6 IS NULL THEN 'UNKNOWN' WHEN return_3 > volatility_6 THEN 'TREND_UP'
  WHEN return_3 < -volatility_6 THEN 'TREND_DOWN' ELSE 'RANGE' END AS regime FROM b""")
def simple_features(t: Tables) -> DataFrame:
    f = X.simple_features(t.bars(60), ["symbol"], ["ts"], day_chunk())
    return f.select("ts", *[rounded(c).alias(c) for c in SIMPLE], "regime")


@query("f16_next_bar_outcome", oracle.bars(60) + f""", a AS (SELECT ts, lead(close) OVER w / nullif(close, 0) - 1 AS next_return, (lead(high) OVER w - close) / nullif(close, 0) AS mfe,
  (lead(low) OVER w - close) / nullif(close, 0) AS mae FROM bars WINDOW w AS (ORDER BY ts)) SELECT ts, {oracle.rs(['next_return', 'mfe', 'mae'])}, {oracle.r('abs(next_return)')} AS next_abs_return FROM a""")
def next_bar(t: Tables) -> DataFrame:
    f = X.next_bar_outcome(t.bars(60), ["symbol"], ["ts"], day_chunk())
    return f.select("ts", *[rounded(c).alias(c) for c in ("next_return", "mfe", "mae", "next_abs_return")])


@query("f17_ratio_partition", QSQL + """, d AS (SELECT DISTINCT session_id FROM states), n AS (SELECT session_id, row_number() OVER (ORDER BY session_id) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT session_id, CASE WHEN i < greatest(floor(n * 0.6), 1) THEN 'DEV' WHEN i < least(greatest(floor(n * 0.8), greatest(floor(n * 0.6), 1) + 1), n - 1) THEN 'VALIDATION' ELSE 'LOCKED_OOS' END AS partition FROM n""")
def ratio_partition(t: Tables) -> DataFrame:
    return X.ratio_partition(t.frame(QUARTER, labels=False), "session_id")


@query("f18_calendar_partition", QSQL + """ SELECT partition, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT ts, CASE
  WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-17' THEN 'DEV' WHEN ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-23' THEN 'VALIDATION'
  WHEN ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-29' THEN 'LOCKED_OOS' ELSE 'OUTSIDE' END AS partition FROM states) GROUP BY partition""")
def calendar_partition(t: Tables) -> DataFrame:
    f = X.calendar_partition(t.bars(15), "ts", POLICY)
    return f.groupBy("partition").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("f19_forward_quote", TICKS_SQL + ", " + oracle.bars(15, chain=True).lstrip() + """, tg AS (SELECT ts + INTERVAL 15 MINUTE AS decision_ts FROM bars)
SELECT decision_ts, coalesce(epoch_us(q.ts) - epoch_us(decision_ts) <= 60000000, false) AS valid, CASE WHEN epoch_us(q.ts) - epoch_us(decision_ts) <= 60000000 THEN q.ts END AS quote_ts,
  CASE WHEN epoch_us(q.ts) - epoch_us(decision_ts) <= 60000000 THEN bid END AS bid, round(CASE WHEN epoch_us(q.ts) - epoch_us(decision_ts) <= 60000000 THEN ask END, 6) AS ask
FROM tg ASOF LEFT JOIN ticks q ON tg.decision_ts <= q.ts""")
def forward_quote(t: Tables) -> DataFrame:
    targets = X.add_clock(t.bars(15), QUARTER)
    q = forward_asof(targets, t.ticks, ["symbol"], "decision_ts", "ts", "tick_id", ["bid", "ask"], A.QUOTE_TOLERANCE_MICROS)
    return q.drop("symbol").withColumn("ask", rounded("ask"))


def experiences(t: Tables) -> DataFrame:
    """Three experiences per quarter-hour state, with real quotes where a tick is near enough.

    As in production, the state table and the experience table are each written once.
    """
    states = t.stored("states", lambda: t.frame(QUARTER))
    return t.stored("experiences", lambda: A.expand_actions(A.attach_quotes(states, t.ticks, QUARTER), QUARTER))


def experiences_sql() -> str:
    quotes = ", ".join(f"q{h} AS (SELECT s.bar_index, q.bid, q.ask FROM (SELECT bar_index, decision_ts + INTERVAL {h * 15} MINUTE AS due FROM states) s "
                       f"ASOF JOIN ticks q ON s.due <= q.ts WHERE epoch_us(q.ts) - epoch_us(s.due) <= 60000000)" for h in (0, *QUARTER.horizons))
    joins = " ".join(f"LEFT JOIN q{h} USING (bar_index)" for h in (0, *QUARTER.horizons))
    cols = []
    for h in QUARTER.horizons:
        g, real = f"label_return_{h}", f"(q0.bid IS NOT NULL AND q{h}.bid IS NOT NULL)"
        lp = f"(close * (1 + {g}) - (close + state_spread_price)) / nullif(close + state_spread_price, 0)"
        sp = f"(close - (close * (1 + {g}) + label_spread_{h} * 0.01)) / nullif(close, 0)"
        lr = f"(q{h}.bid - q0.ask) / nullif(q0.ask, 0)"
        sr = f"(q0.bid - q{h}.ask) / nullif(q0.bid, 0)"
        zero = f"CASE WHEN {g} IS NOT NULL THEN 0.0 END"
        cols += [f"CASE action WHEN 'LONG' THEN {g} WHEN 'SHORT' THEN -{g} ELSE {zero} END AS gross_{h}",
                 f"CASE WHEN {g} IS NULL THEN NULL WHEN action = 'WAIT' THEN 0.0 WHEN action = 'LONG' THEN CASE WHEN {real} THEN {lr} ELSE {lp} END "
                 f"ELSE CASE WHEN {real} THEN {sr} ELSE {sp} END END AS net_{h}",
                 f"CASE action WHEN 'LONG' THEN label_up_{h} WHEN 'SHORT' THEN -label_down_{h} ELSE {zero} END AS mfe_{h}",
                 f"CASE action WHEN 'LONG' THEN label_down_{h} WHEN 'SHORT' THEN -label_up_{h} ELSE {zero} END AS mae_{h}",
                 f"CASE WHEN action = 'WAIT' THEN 'NO_POSITION' WHEN {real} THEN 'REAL_TICK_COST' ELSE 'PROXY_COST' END AS cost_method_{h}"]
    return (QSQL + ", " + TICKS_SQL.replace("WITH ", "", 1) + ", " + quotes + f""", exp0 AS (SELECT states.*, action, {', '.join(cols)}
  FROM states {joins} CROSS JOIN (VALUES ('WAIT'), ('LONG'), ('SHORT')) v(action)),
exps AS (SELECT *, {', '.join(f'gross_{h} - net_{h} AS cost_{h}' for h in QUARTER.horizons)} FROM exp0)""")


ESQL = experiences_sql()
OUTCOMES = ["gross", "net", "mfe", "mae", "cost"]


@query("f20_action_expansion", ESQL + " " + " UNION ALL ".join(
    f"SELECT ts, action, {h} AS horizon, {', '.join(f'{oracle.r(f + "_" + str(h))} AS {f}' for f in OUTCOMES)}, cost_method_{h} AS cost_method FROM exps" for h in QUARTER.horizons))
def action_expansion(t: Tables) -> DataFrame:
    long = A.unpivot_horizons(experiences(t), ["ts", "action"], QUARTER.horizons)
    return rounded_all(long, OUTCOMES)


@query("f21_experience_identity", QSQL + """, e AS (SELECT sha256(concat_ws('|', 'V1', session_id, strftime(decision_ts, '%Y%m%d%H%M%S'), action)) AS experience_id, session_id, decision_ts, action
  FROM states CROSS JOIN (VALUES ('WAIT'), ('LONG'), ('SHORT')) v(action)) SELECT *, (SELECT count(*) FROM (SELECT experience_id FROM e GROUP BY 1 HAVING count(*) > 1)) AS conflicts FROM e""")
def identity(t: Tables) -> DataFrame:
    states = t.frame(QUARTER, labels=False).withColumn("action", F.explode(F.array(*[F.lit(a) for a in A.ACTIONS])))
    named = A.with_identity(states, "V1").select("experience_id", "session_id", "decision_ts", "action")
    conflicts = A.identity_conflicts(named).agg(F.count(F.lit(1)).alias("conflicts"))
    return named.withColumn("conflicts", conflicts.scalar())


DERIVED = ["state_abs_return_1", "state_abs_return_5", "state_abs_momentum", "state_min_distance", "state_vol_ratio", "state_atr_range"]


@query("f22_derived_states", QSQL + f""" SELECT ts, {oracle.r('abs(state_return_1)')} AS state_abs_return_1, {oracle.r('abs(state_return_5)')} AS state_abs_return_5,
  {oracle.r('abs(state_momentum)')} AS state_abs_momentum, {oracle.r('least(state_dist_high, state_dist_low)')} AS state_min_distance,
  {oracle.r('state_vol_short / nullif(state_vol_long, 0)')} AS state_vol_ratio, {oracle.r('state_atr / nullif(state_bar_range, 0)')} AS state_atr_range FROM states""")
def derived(t: Tables) -> DataFrame:
    f = X.derived_states(t.frame(QUARTER, labels=False), (1, 5))
    return f.select("ts", *[rounded(c).alias(c) for c in DERIVED])


@query("f23_cost_simple", TICKS_SQL + f""" SELECT tick_id, action, CASE WHEN action = 'WAIT' THEN 'NO_POSITION' WHEN points = 0 THEN 'UNAVAILABLE' ELSE 'BAR_SPREAD_APPROXIMATION' END AS method,
  {oracle.r("CASE WHEN action = 'WAIT' THEN 0.0 WHEN points = 0 THEN NULL ELSE points * 0.01 / nullif(bid, 0) END")} AS round_trip_return,
  CASE WHEN action = 'WAIT' THEN 'EXACT' WHEN points = 0 THEN 'NOT_COMPUTABLE_WITHOUT_BID_ASK_OR_BAR_SPREAD' ELSE 'APPROXIMATION' END AS quality
  FROM ticks CROSS JOIN (VALUES ('WAIT'), ('LONG')) v(action)""")
def cost_simple(t: Tables) -> DataFrame:
    df = t.ticks.withColumn("action", F.explode(F.array(F.lit("WAIT"), F.lit("LONG")))).withColumnRenamed("bid", "close")
    df = df.withColumn("spread_price", F.when(F.col("points") != 0, F.col("points") * POINT))
    return A.cost_simple(df).select("tick_id", "action", "method", rounded("round_trip_return").alias("round_trip_return"), "quality")


@query("f23_cost_layered", TICKS_SQL + f""" SELECT tick_id, CASE WHEN points > 66 THEN 'REAL_TICK_COST' WHEN points > 33 THEN 'PROXY_COST' ELSE 'UNAVAILABLE' END AS method,
  {oracle.r('CASE WHEN points > 66 THEN (ask - bid) / nullif(ask, 0) WHEN points > 33 THEN points * 0.01 / nullif(bid, 0) END')} AS round_trip_return,
  CASE WHEN points > 66 THEN 'HIGH' WHEN points > 33 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  'UNAVAILABLE_NOT_ASSUMED_ZERO' AS slippage_status FROM ticks""")
def cost_layered(t: Tables) -> DataFrame:
    """Wide quotes carry a real cost, middling ones only a spread, the rest neither."""
    df = (t.ticks.withColumn("real_tick_cost", F.when(F.col("points") > 66, (F.col("ask") - F.col("bid")) / F.col("ask")))
                 .withColumn("spread_price", F.when(F.col("points") > 33, F.col("points") * POINT))
                 .withColumn("estimated_slippage", F.lit(None).cast("double")).withColumnRenamed("bid", "close"))
    return A.cost_layered(df).select("tick_id", "method", rounded("round_trip_return").alias("round_trip_return"), "confidence", "slippage_status")


@query("f24_potential_slippage", TICKS_SQL + f""", d AS (SELECT tick_id, ts, (bid + ask) / 2 AS mid, ms, ts + to_milliseconds(ms) AS due FROM ticks CROSS JOIN (VALUES (100), (500), (1000)) v(ms))
SELECT d.tick_id, d.ts, ms AS delay_ms, {oracle.r('abs((q.bid + q.ask) / 2 - d.mid)')} AS slippage FROM d ASOF LEFT JOIN ticks q ON d.due <= q.ts""")
def slippage(t: Tables) -> DataFrame:
    return rounded_all(potential_slippage(t.ticks, ["symbol"], (100, 500, 1000), "tick_id").drop("symbol"), ["slippage"])


@query("f25_leakage_gate", QSQL + """ SELECT count(*) AS "rows", count(*) FILTER (NOT state_max_source_ts < decision_ts) AS state_violations,
  count(*) FILTER (label_source_ts_1 <= state_max_source_ts OR label_source_ts_3 <= state_max_source_ts OR label_source_ts_5 <= state_max_source_ts OR label_source_ts_10 <= state_max_source_ts) AS label_violations FROM states""")
def leakage(t: Tables) -> DataFrame:
    return X.leakage_violations(t.frame(QUARTER), QUARTER.horizons)
