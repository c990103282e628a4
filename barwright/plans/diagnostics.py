"""Diagnostics, source comparison and file-source queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from barwright.functions.hashing import hashed_int
from barwright.functions.numeric import rounded
from barwright.operators import diagnostics as D, quality as Q
from barwright.plans import oracle
from barwright.plans.bindings import POINT, Tables, day_chunk, rounded_all
from barwright.plans.quality import META, TAU, TICKS_SQL
from barwright.plans.registry import query
from barwright.session import ensure_checkpoint_dir, materialize
from barwright.sources import files
from barwright.sources.bars import build_bars, normalize_feed

KEYS = ["symbol"]


def steady(t: Tables) -> DataFrame:
    """Clean bars with flat stretches, so that stale episodes exist."""
    b = t.bars(TAU)
    flat = F.pmod(hashed_int(F.lit("flat"), F.floor(F.col("bar_index") / 8).cast("bigint")), F.lit(12)) == 0
    return (b.withColumn("source_row", F.col("bar_index"))
             .withColumn("close", F.when(flat, F.lit(20.0)).otherwise(F.col("close")))
             .withColumn("open", F.when(flat, F.lit(20.0)).otherwise(F.col("open")))
             .withColumn("high", F.when(flat, F.greatest("high", F.lit(20.0))).otherwise(F.col("high")))
             .withColumn("low", F.when(flat, F.least("low", F.lit(20.0))).otherwise(F.col("low"))))


def facts(t: Tables) -> DataFrame:
    return materialize(Q.add_neighbour_facts(materialize(steady(t)), KEYS, TAU))


def other_source(t: Tables) -> DataFrame:
    """An independent provider: bars of the events that are not errors, on a clock two hours behind."""
    seen = t.events.where(F.col("event_type") != "error").withColumn("ts", F.col("ts") - F.expr("interval 2 hours"))
    bars = build_bars(seen, TAU, time="ts", value="value", tiebreak="event_id",
                      spread=F.get_json_object("props", "$.k"), actor="user_id", symbol=F.lit("EVT"))
    return bars.withColumn("source_row", F.col("bar_index"))


STEADY_SQL = oracle.bars(TAU, "bars0") + """, slots AS (SELECT *, ('0x' || substr(md5('flat:' || (bar_index // 8)), 1, 8))::BIGINT % 12 = 0 AS flat FROM bars0),
bars AS (SELECT * REPLACE (CASE WHEN flat THEN 20.0 ELSE close END AS close, CASE WHEN flat THEN 20.0 ELSE open END AS open,
  CASE WHEN flat THEN greatest(high, 20.0) ELSE high END AS high, CASE WHEN flat THEN least(low, 20.0) ELSE low END AS low),
  bar_index AS source_row FROM slots),
f0 AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000 AS m, lag(ts) OVER w AS pts, lag(source_row) OVER w AS prow,
  lag(close) OVER w AS pc, (close = lag(close) OVER w)::INT AS same FROM bars WINDOW w AS (ORDER BY ts)),
f AS (SELECT *, close / nullif(pc, 0) - 1 AS chg,
  coalesce(sum(same) OVER (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5, false) AS stale FROM f0),
gaps AS (SELECT source_row, prow AS previous_row, pts AS previous_ts, ts AS next_ts, m AS elapsed_minutes, m / 15 - 1 AS absent_bars,
  strftime(pts, '%H:%M') AS previous_clock, strftime(ts, '%H:%M') AS next_clock, dayname(pts) AS previous_weekday, dayname(ts) AS next_weekday,
  CASE WHEN len(list_filter(generate_series(pts::DATE, ts::DATE, INTERVAL 1 DAY), lambda d: isodow(d) >= 6)) > 0 THEN 'WEEKEND_SPANNING'
       WHEN pts::DATE <> ts::DATE THEN 'CROSS_DATE' ELSE 'INTRADAY' END AS morphology, 'UNRESOLVED' AS cause FROM f WHERE m > 15),
found AS (SELECT source_row, ts, 'ZERO_SPREAD' AS code FROM f WHERE spread = 0 UNION ALL SELECT source_row, ts, 'GAP' FROM f WHERE m > 15
  UNION ALL SELECT source_row, ts, 'PRICE_JUMP' FROM f WHERE abs(chg) > 0.02 UNION ALL SELECT source_row, ts, 'STALE_RUN' FROM f WHERE stale),
runs AS (SELECT *, sum(CASE WHEN close = pc THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS run FROM f),
episodes AS (SELECT min(ts) AS run_start, max(ts) AS run_end, min(source_row) AS first_row, max(source_row) AS last_row, count(*) AS bars,
  count(*) FILTER (stale) AS alerts, arg_min(close, ts) AS close, count(*) FILTER (m > 15) - max(CASE WHEN ts = rs AND m > 15 THEN 1 ELSE 0 END) AS gap_edges,
  count(*) FILTER (high <> low) AS nonflat_bars, count(*) FILTER (tick_volume > 0) AS positive_tick_bars
  FROM (SELECT *, min(ts) OVER (PARTITION BY run) AS rs FROM runs) GROUP BY run HAVING count(*) FILTER (stale) > 0)"""

OTHER_SQL = oracle.bars(TAU, "hbars", chain=True).replace("FROM events)", "FROM (SELECT event_id, ts - INTERVAL 2 HOUR AS ts, user_id, value, props FROM events WHERE event_type <> 'error'))").lstrip()


@query("dx01_gap_morphology", STEADY_SQL + " SELECT * REPLACE (round(elapsed_minutes, 6) AS elapsed_minutes, round(absent_bars, 6) AS absent_bars) FROM gaps")
def gap_morphology(t: Tables) -> DataFrame:
    return rounded_all(D.gap_table(facts(t), TAU), ["elapsed_minutes", "absent_bars"])


def recorded(t: Tables) -> DataFrame:
    meta = {**META, "broker": None, "source_id": None}
    bars = t.stored("bronze_steady", lambda: Q.bronze(steady(t).drop("bar_index"), "source_row").withColumn("dataset", F.lit("D")))
    return Q.findings_of(Q.certify(bars, meta, TAU)).where(
        F.col("code").isin("ZERO_SPREAD", "GAP", "PRICE_JUMP", "STALE_RUN")).withColumn("symbol", F.lit("EVT"))


@query("dx02_anomaly_rows", STEADY_SQL + f""" SELECT found.source_row, found.ts, code, {oracle.r('m')} AS elapsed, {oracle.r('pc')} AS previous_close,
  {oracle.r('chg')} AS change, {oracle.r('close')} AS close FROM found JOIN f USING (source_row)""")
def anomaly_rows(t: Tables) -> DataFrame:
    rows = D.anomaly_rows(recorded(t).select("symbol", "source_row", "ts", "code"), facts(t), KEYS)
    return rows.select("source_row", "ts", "code", *[rounded(c).alias(c) for c in ("elapsed", "previous_close", "change", "close")])


@query("dx03_stale_episodes", STEADY_SQL + " SELECT * FROM episodes")
def stale(t: Tables) -> DataFrame:
    return D.stale_episodes(facts(t), KEYS, day_chunk(), TAU).drop("symbol")


@query("dx04_contiguous_segments", STEADY_SQL + """, s AS (SELECT *, sum(CASE WHEN m = 15 THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS seg FROM f)
 SELECT min(ts) AS segment_start, max(ts) AS segment_end, count(*) AS "rows", min(source_row) AS first_row, max(source_row) AS last_row,
 count(*) FILTER (source_row IN (SELECT source_row FROM found)) AS flagged_rows FROM s GROUP BY seg""")
def contiguous(t: Tables) -> DataFrame:
    return D.segments(facts(t), recorded(t), KEYS, day_chunk(), TAU).drop("symbol")


@query("dx05_reconciliation", STEADY_SQL + " SELECT code, count(*) AS recorded, count(*) AS recomputed, 0::BIGINT AS missing, 0::BIGINT AS extra FROM found GROUP BY code")
def reconciliation(t: Tables) -> DataFrame:
    f = facts(t)
    checks = Q.series_checks(TAU) + [Q.finding(F.col("spread") == 0, "ZERO_SPREAD", Q.KEEP, "")]
    again = Q.explode_findings(f, checks, KEYS).where(F.col("code") != "IRREGULAR_INTERVAL")
    return D.reconcile(recorded(t), again, KEYS)


@query("dx06_integrity_summary", STEADY_SQL + """ SELECT (SELECT count(*) FROM f) AS "rows", (SELECT count(*) FROM f WHERE spread = 0) AS zero_spread_rows,
  (SELECT count(*) FROM gaps) AS gaps, (SELECT coalesce(round(sum(absent_bars), 6), 0) FROM gaps) AS absent_bars, (SELECT count(*) FROM episodes) AS stale_episodes,
  (SELECT count(*) FROM episodes WHERE gap_edges > 0) AS stale_crossing_gaps, (SELECT coalesce(sum(nonflat_bars), 0)::BIGINT FROM episodes) AS stale_nonflat_bars""")
def summary(t: Tables) -> DataFrame:
    f = facts(t)
    out = D.integrity_summary(f, D.gap_table(f, TAU), D.stale_episodes(f, KEYS, day_chunk(), TAU))
    return rounded_all(out, ["absent_bars"])


@query("dx06_morphology_counts", STEADY_SQL + " SELECT morphology, count(*) AS gaps, round(sum(absent_bars), 6) AS absent_bars FROM gaps GROUP BY morphology")
def morphology_counts(t: Tables) -> DataFrame:
    return rounded_all(D.gap_summary(D.gap_table(facts(t), TAU)), ["absent_bars"])


@query("dx07_gap_triage", STEADY_SQL + """ SELECT triage, count(*) AS gaps, round(sum(absent_bars), 6) AS absent_bars FROM (SELECT *,
  CASE WHEN morphology = 'WEEKEND_SPANNING' THEN 'WEEKEND_CLOSURE_CANDIDATE_UNVERIFIED'
       WHEN (previous_clock, next_clock) IN (('23:58','01:00'), ('22:58','00:00'), ('00:13','01:00'), ('23:13','00:00')) THEN 'RECURRING_SESSION_PATTERN_UNVERIFIED'
       WHEN morphology = 'INTRADAY' AND elapsed_minutes IN (30, 45) THEN 'SHORT_INTRADAY_UNRESOLVED' ELSE 'OTHER_UNRESOLVED' END AS triage FROM gaps) GROUP BY triage""")
def triage(t: Tables) -> DataFrame:
    rows = D.gap_triage(D.gap_table(facts(t), TAU), (2 * TAU, 3 * TAU))
    return rows.groupBy("triage").agg(F.count(F.lit(1)).alias("gaps"), rounded(F.sum("absent_bars")).alias("absent_bars"))


H_FACTS = """, hf0 AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000 AS m, close / nullif(lag(close) OVER w, 0) - 1 AS chg,
  (close = lag(close) OVER w)::INT AS same FROM hbars WINDOW w AS (ORDER BY ts)),
hf AS (SELECT *, coalesce(sum(same) OVER (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5, false) AS stale FROM hf0)"""


@query("dx08_external_quality", "WITH " + OTHER_SQL.lstrip(", ") + H_FACTS + """ SELECT year(ts)::INT AS year, count(*) AS "rows",
  count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_price, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS invalid_ohlc,
  0::BIGINT AS off_grid, count(*) FILTER (abs(chg) > 0.02) AS price_jump, count(*) FILTER (stale) AS stale_run, count(*) FILTER (m > 15) AS gaps,
  round(sum(CASE WHEN m > 15 THEN m / 15 - 1 ELSE 0 END), 6) AS absent_bars, count(DISTINCT ts::DATE) AS days, 0::BIGINT AS duplicate_timestamp_rows,
  round(count(*) / (date_diff('day', make_date(year(ts), 1, 1), make_date(year(ts) + 1, 1, 1)) * 96.0), 6) AS coverage_24h FROM hf GROUP BY year(ts)""")
def external_quality(t: Tables) -> DataFrame:
    f = materialize(Q.add_neighbour_facts(materialize(other_source(t)), KEYS, TAU))
    return rounded_all(D.source_profile(f, TAU, F.year("ts"), KEYS), ["absent_bars", "coverage_24h"])


@query("dx09_clock_offset_scan", STEADY_SQL + ", " + OTHER_SQL.lstrip(", ") + f""", j AS (SELECT o.h AS hours, strftime(b.ts, '%Y-%m') AS month, abs(b.open - x.open) AS d1,
  abs(b.high - x.high) AS d2, abs(b.low - x.low) AS d3, abs(b.close - x.close) AS d4
  FROM bars b CROSS JOIN (SELECT unnest(range(-12, 13))::INT AS h) o JOIN hbars x ON x.bar_index = b.bar_index - o.h * 4),
p AS (SELECT *, 'ALL' AS period FROM j UNION ALL SELECT *, month FROM j),
q AS (SELECT hours, period, unnest([d1, d2, d3, d4]) AS d FROM p)
SELECT a.*, b.median_abs_ohlc, b.p95_abs_ohlc FROM (SELECT hours, period, count(*) AS matched_bars, {oracle.r('avg((d1 + d2 + d3 + d4) / 4)')} AS mean_abs_ohlc,
  count(*) FILTER (d1 = 0 AND d2 = 0 AND d3 = 0 AND d4 = 0) AS exact_bars, {oracle.r('quantile_cont(d4, 0.5)')} AS median_abs_close FROM p GROUP BY hours, period) a
JOIN (SELECT hours, period, {oracle.r('quantile_cont(d, 0.5)')} AS median_abs_ohlc, {oracle.r('quantile_cont(d, 0.95)')} AS p95_abs_ohlc FROM q GROUP BY hours, period) b USING (hours, period)""")
def offset_scan(t: Tables) -> DataFrame:
    out = D.clock_offset_scan(materialize(steady(t)), materialize(other_source(t)), TAU, range(-12, 13), F.date_format("ts", "yyyy-MM"))
    return rounded_all(out, ["mean_abs_ohlc", "median_abs_ohlc", "p95_abs_ohlc", "median_abs_close"])


@query("dx10_gap_presence", STEADY_SQL + ", " + OTHER_SQL.lstrip(", ") + """, g AS (SELECT source_row, h AS hours, previous_ts + INTERVAL 15 MINUTE - to_hours(h) AS start,
  next_ts - to_hours(h) AS end_exclusive, absent_bars::BIGINT AS absent_bars FROM gaps CROSS JOIN (VALUES (0), (2), (3)) v(h)),
c AS (SELECT g.*, (SELECT count(*) FROM hbars x WHERE x.ts >= g.start AND x.ts < g.end_exclusive) AS present_bars FROM g)
SELECT *, CASE WHEN present_bars = absent_bars THEN 'ALL_PRESENT' WHEN present_bars = 0 THEN 'ALL_ABSENT' ELSE 'PARTIAL' END AS relation FROM c""")
def presence(t: Tables) -> DataFrame:
    return D.gap_presence(D.gap_table(facts(t), TAU), other_source(t), TAU, (0, 2, 3))


@query("dx11_window_profile", STEADY_SQL + ", " + OTHER_SQL.lstrip(", ") + H_FACTS + f""", w AS (SELECT 'STALE_' || strftime(run_start, '%Y%m%d%H%M') AS label, h AS hours,
  run_start - to_hours(h) AS "start", run_end - to_hours(h) AS "end" FROM episodes CROSS JOIN (VALUES (0), (2), (3)) v(h))
SELECT label, hours, "start", "end", (date_diff('minute', "start", "end") / 15 + 1)::BIGINT AS expected_bars, count(hf.close) AS bars, count(DISTINCT hf.close) AS distinct_closes,
  count(*) FILTER (hf.stale) AS stale_alerts, count(*) FILTER (abs(hf.chg) > 0.02) AS jump_alerts, {oracle.r('min(hf.chg)')} AS min_return,
  count(*) FILTER (hf.high <> hf.low) AS nonflat_bars, (date_diff('minute', "start", "end") / 15 + 1)::BIGINT - count(hf.close) AS missing_bars
FROM w LEFT JOIN hf ON hf.ts BETWEEN w."start" AND w."end" GROUP BY label, hours, "start", "end" """)
def windows(t: Tables) -> DataFrame:
    episodes = D.stale_episodes(facts(t), KEYS, day_chunk(), TAU)
    labelled = episodes.select(F.concat(F.lit("STALE_"), F.date_format("run_start", "yyyyMMddHHmm")).alias("label"),
                               F.col("run_start").alias("start_ts"), F.col("run_end").alias("end_ts"))
    other = Q.add_neighbour_facts(materialize(other_source(t)), KEYS, TAU)
    return rounded_all(D.window_profile(labelled, other, TAU, (0, 2, 3)), ["min_return"])


@query("dx12_coverage_by_year", STEADY_SQL + ", " + OTHER_SQL.lstrip(", ") + """ SELECT coalesce(a.period, b.period) AS period, coalesce(our_bars, 0) AS our_bars,
  our_first, our_last, coalesce(other_bars, 0) AS other_bars, coalesce(matching, 0) AS matching FROM
  (SELECT year(ts)::INT AS period, count(*) AS our_bars, min(ts) AS our_first, max(ts) AS our_last, count(*) FILTER (ts IN (SELECT ts FROM hbars)) AS matching FROM bars GROUP BY 1) a
  FULL JOIN (SELECT year(ts)::INT AS period, count(*) AS other_bars FROM hbars GROUP BY 1) b USING (period)""")
def coverage_by_year(t: Tables) -> DataFrame:
    return D.coverage_by_period(steady(t), other_source(t), F.year("ts"))


# ---- sources -------------------------------------------------------------------------------------

@query("src01_bar_contract", oracle.bars(5) + """ SELECT count(*) AS bars, 0 AS problems, 2 AS problems_without_timeframe, round(sum(close), 4) AS close_sum FROM bars""")
def bar_contract(t: Tables) -> DataFrame:
    """Bars are admitted only under a complete declaration; the counts of violations ride along."""
    meta = {"source_id": "E", "broker": "B", "symbol_exact": "EVT", "symbol_international": "EVT", "timeframe": "M5", "timezone": "UTC",
            "point": POINT, "digits": 2, "timestamp_semantics": "BAR_OPEN"}
    t.stored("bars_5", lambda: t.bars(5))
    bars = files.read_bars(t.spark, t.stored_path("bars_5"), meta)
    lacking = {k: v for k, v in meta.items() if k != "timeframe"}
    good, bad = files.contract_problems(meta, bars.columns), files.contract_problems(lacking, bars.columns)
    return bars.agg(F.count(F.lit(1)).alias("bars"), F.lit(len(good)).alias("problems"),
                    F.lit(len(bad)).alias("problems_without_timeframe"), rounded(F.sum("close"), 4).alias("close_sum"))


@query("src02_projection_limit", oracle.bars(TAU) + " SELECT ts, close, spread FROM bars ORDER BY ts LIMIT 500")
def projection(t: Tables) -> DataFrame:
    return files.project(t.bars(TAU), ["ts", "close", "spread"], limit=500, order=["ts"])


@query("src03_partition_admission", oracle.bars(TAU) + """ SELECT strftime(ts, '%G-W%V') AS unit, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS "rows",
  CASE WHEN min(ts) >= TIMESTAMP '2024-01-08' AND max(ts) + INTERVAL 15 MINUTE < TIMESTAMP '2024-01-24' THEN 'ADMIT'
       WHEN max(ts) + INTERVAL 15 MINUTE <= TIMESTAMP '2024-01-08' OR min(ts) >= TIMESTAMP '2024-01-24' THEN 'OUTSIDE' ELSE 'DENY_STRADDLE' END AS decision FROM bars GROUP BY 1""")
def partition_admission(t: Tables) -> DataFrame:
    """Bars stored in one folder per ISO week; a folder is admitted by the footers of its files, no data page is opened."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "ts"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    t.stored("bars_by_week", lambda: t.bars(TAU).withColumn("week", week), ["week"])
    spans = files.row_group_spans(t.spark, t.stored_path("bars_by_week"), "ts")
    return files.footer_admission(spans, F.regexp_extract("file", "week=([^/]+)/", 1), "2024-01-08 00:00:00", "2024-01-24 00:00:00", TAU)


@query("src03_admitted_scan", oracle.bars(TAU) + """, u AS (SELECT strftime(ts, '%G-W%V') AS unit, min(ts) >= TIMESTAMP '2024-01-08' AND max(ts) + INTERVAL 15 MINUTE < TIMESTAMP '2024-01-24' AS ok FROM bars GROUP BY 1)
 SELECT ts, round(close, 6) AS close FROM bars JOIN u ON u.unit = strftime(bars.ts, '%G-W%V') WHERE ok""")
def admitted_scan(t: Tables) -> DataFrame:
    """The bars of admitted folders only: the partition filter keeps the others from being opened."""
    units = partition_admission(t).where("decision = 'ADMIT'").select(F.col("unit").alias("week"))
    return t.spark.read.parquet(t.stored_path("bars_by_week")).join(units, "week", "left_semi").select("ts", rounded("close").alias("close"))


@query("src05_text_bars", oracle.bars(TAU) + """ SELECT strftime(ts - INTERVAL 5 HOUR, '%Y%m%d %H%M%S') AS timestamp_raw, ts, round(open, 6) AS open,
  round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, tick_volume AS volume_raw FROM bars""")
def text_bars(t: Tables) -> DataFrame:
    """Bars written as provider text in a fixed UTC-5 clock, read from the files and parsed back strictly."""
    line = F.concat_ws(";", F.date_format(F.col("ts") - F.expr("interval 5 hours"), "yyyyMMdd HHmmss"),
                       *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "tick_volume")])
    path = f"{ensure_checkpoint_dir(t.spark)}/text-{uuid.uuid4().hex}"
    t.bars(TAU).select(line.alias("value")).write.text(path)
    text = files.read_text_bars(t.spark, path).select(*files.TEXT_SCHEMA.names)
    return rounded_all(files.parse_text_bars(text), ["open", "high", "low", "close"])


@query("src06_month_ranges", """SELECT greatest(m, a) AS range_start, least(m + INTERVAL 1 MONTH, b) AS range_end FROM
  (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b, unnest(generate_series(date_trunc('month', min(o_orderdate))::TIMESTAMP, date_trunc('month', max(o_orderdate))::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM orders) WHERE greatest(m, a) < least(m + INTERVAL 1 MONTH, b)""")
def month_ranges(t: Tables) -> DataFrame:
    return files.month_ranges(t.read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "o_orderdate")


@query("src06_keep_last", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def keep_last(t: Tables) -> DataFrame:
    """Rows fetched twice at a range boundary keep the last."""
    twice = t.events.unionByName(t.events)
    return files.keep_last(twice.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"],
                           ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("src07_tick_normalisation", TICKS_SQL + f""" SELECT tick_id, make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts, {oracle.r('(bid + ask) / 2')} AS mid,
  {oracle.r('ask - bid')} AS spread_price, {oracle.r('(ask - bid) / 0.01', 4)} AS spread_points FROM ticks""")
def tick_normalisation(t: Tables) -> DataFrame:
    wire = t.ticks.withColumn("time_msc", F.unix_millis("ts"))
    out = files.normalize_ticks(wire, POINT)
    return out.select("tick_id", "ts", rounded("mid").alias("mid"), rounded("spread_price").alias("spread_price"),
                      rounded("spread_points", 4).alias("spread_points"))


@query("src08_simple_normaliser", oracle.bars(TAU) + """ SELECT 'EVT' AS symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close,
  tick_volume, NULL::DOUBLE AS spread, NULL::DOUBLE AS real_volume FROM bars ORDER BY ts""")
def simple_normaliser(t: Tables) -> DataFrame:
    src = t.bars(TAU).withColumn("symbol", F.lower("symbol")).drop("spread", "real_volume")
    return rounded_all(normalize_feed(src), ["open", "high", "low", "close"])
