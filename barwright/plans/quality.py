"""Quality queries: a feed with injected transcription faults, derived from the event bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barwright.functions.clock import local_to_utc
from barwright.functions.hashing import hashed_int
from barwright.functions.numeric import change, count_where, rounded, share
from barwright.operators import quality as Q
from barwright.operators.sequence import CHUNK, CORE, chunk_window, with_row_halo
from barwright.plans import oracle
from barwright.plans.bindings import POINT, Tables, day_chunk
from barwright.plans.registry import query
from barwright.sources import files

KEYS = ["dataset"]
META = {"symbol": "EVT", "point": POINT, "broker": "HOME", "source_id": "EVENTS"}
TAU = 15


def feed(t: Tables) -> DataFrame:
    """Quarter-hour bars with faults chosen by hash, in a source order that is not always chronological."""
    b = t.bars(TAU)
    i = F.col("bar_index")
    slot = F.pmod(hashed_int(F.lit("feed"), i), F.lit(48))
    flat = F.pmod(hashed_int(F.lit("flat"), F.floor(i / 8).cast("bigint")), F.lit(12)) == 0

    def at(n: int, new, old):
        return F.when(slot == n, new).otherwise(old)

    d = b.withColumn("slot", slot)
    d = (d.withColumn("close", F.when(flat, F.lit(20.0)).otherwise(F.col("close")))
          .withColumn("open", F.when(flat, F.lit(20.0)).otherwise(F.col("open")))
          .withColumn("high", F.when(flat, F.greatest("high", F.lit(20.0))).otherwise(F.col("high")))
          .withColumn("low", F.when(flat, F.least("low", F.lit(20.0))).otherwise(F.col("low"))))
    d = d.select(
        F.lit("FEED").alias("dataset"),
        (i * 4 + at(15, F.lit(14), F.lit(0))).alias("source_row"),
        at(7, F.lit("ALT"), F.col("symbol")).alias("symbol"),
        F.timestamp_micros(F.unix_micros("ts") + at(8, F.lit(7_000_000), F.lit(0))).alias("ts"),
        "open", at(1, F.col("low") - 1, F.col("high")).alias("high"), "low",
        F.when(slot == 2, -F.col("close")).when(slot == 9, F.lit(None)).when(slot == 13, F.col("close") * 1.5).when(slot == 16, F.lit(0.0))
         .otherwise(F.col("close")).cast("double").alias("close"),
        at(5, F.lit(0.0), F.col("tick_volume")).alias("tick_volume"),
        F.when(slot == 3, -1 - F.col("spread")).when(slot == 4, F.lit(0.0)).when(slot == 14, F.abs("close") * 200)
         .otherwise(F.col("spread")).alias("spread"),
        at(6, F.lit(-1.0), F.col("real_volume")).alias("real_volume"),
        at(10, F.lit("OTHER"), F.lit("HOME")).alias("broker"), "slot")
    extra = F.when(F.col("slot").isin(11, 12), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("_copy", F.explode(extra))
    return (d.withColumn("source_row", F.col("source_row") + F.col("_copy"))
             .withColumn("spread", F.col("spread") + F.when((F.col("slot") == 12) & (F.col("_copy") == 1), 1.0).otherwise(0.0))
             .drop("slot", "_copy"))


def raw(t: Tables) -> DataFrame:
    return Q.bronze(feed(t), "source_row")


def certified(t: Tables) -> DataFrame:
    return Q.certify(t.stored("bronze_feed", lambda: raw(t)), META, TAU)


FEED_SQL = oracle.bars(TAU) + """, slots AS (
  SELECT *, ('0x' || substr(md5('feed:' || bar_index), 1, 8))::BIGINT % 48 AS slot,
         ('0x' || substr(md5('flat:' || (bar_index // 8)), 1, 8))::BIGINT % 12 = 0 AS flat FROM bars),
steady AS (SELECT * REPLACE (CASE WHEN flat THEN 20.0 ELSE close END AS close, CASE WHEN flat THEN 20.0 ELSE open END AS open,
  CASE WHEN flat THEN greatest(high, 20.0) ELSE high END AS high, CASE WHEN flat THEN least(low, 20.0) ELSE low END AS low) FROM slots),
feed AS (SELECT 'FEED' AS dataset, bar_index * 4 + CASE WHEN slot = 15 THEN 14 ELSE 0 END + cp AS source_row,
  CASE WHEN slot = 7 THEN 'ALT' ELSE symbol END AS symbol,
  CASE WHEN slot = 8 THEN ts + INTERVAL 7 SECOND ELSE ts END AS ts, open,
  CASE WHEN slot = 1 THEN low - 1 ELSE high END AS high, low,
  CASE slot WHEN 2 THEN -close WHEN 9 THEN NULL WHEN 13 THEN close * 1.5 WHEN 16 THEN 0 ELSE close END::DOUBLE AS close,
  CASE WHEN slot = 5 THEN 0 ELSE tick_volume END AS tick_volume,
  CASE slot WHEN 3 THEN -1 - spread WHEN 4 THEN 0 WHEN 14 THEN abs(close) * 200 ELSE spread END
    + CASE WHEN slot = 12 AND cp = 1 THEN 1 ELSE 0 END AS spread,
  CASE WHEN slot = 6 THEN -1 ELSE real_volume END AS real_volume,
  CASE WHEN slot = 10 THEN 'OTHER' ELSE 'HOME' END AS broker
  FROM steady CROSS JOIN (VALUES (0), (1)) v(cp) WHERE cp = 0 OR slot IN (11, 12)),
dupes AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts, open, high, low, close, tick_volume, spread, real_volume, broker
                                       ORDER BY source_row) > 1 AS dup FROM feed),
silver AS (SELECT * FROM dupes WHERE NOT dup),
near AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us, lag(close) OVER w AS pc,
  (close = lag(close) OVER w)::INT AS same FROM silver WINDOW w AS (ORDER BY ts, source_row)),
facts AS (SELECT *, sum(same) OVER (ORDER BY ts, source_row ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS stale,
  CASE WHEN pc = 0 THEN close <> 0 ELSE abs(close / pc - 1) > 0.02 END AS jump FROM near)"""

ROW_RULES = {
    "NONFINITE_OR_NULL": ("REJECT", "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR tick_volume IS NULL OR spread IS NULL OR real_volume IS NULL"),
    "NONPOSITIVE_PRICE": ("REJECT", "least(open, high, low, close) <= 0"),
    "INVALID_OHLC": ("REJECT", "high < greatest(open, close, low) OR low > least(open, close, high)"),
    "NEGATIVE_SPREAD": ("REJECT", "spread < 0"),
    "ZERO_SPREAD": ("KEEP_FLAGGED", "spread = 0"),
    "NEGATIVE_VOLUME": ("REJECT", "tick_volume < 0 OR real_volume < 0"),
    "NO_TICK_VOLUME": ("KEEP_FLAGGED", "tick_volume = 0"),
    "SYMBOL_CHANGE": ("REJECT", "symbol <> 'EVT'"),
    "BROKER_OR_CONTRACT_CHANGE": ("REVIEW", "broker <> 'HOME'"),
    "OFF_GRID_TIME": ("REVIEW", "epoch_us(ts) % 900000000 <> 0"),
    "WIDE_SPREAD": ("KEEP_FLAGGED", "CASE WHEN close = 0 THEN spread > 0 ELSE spread * 0.01 / close > 0.01 END"),
}
SERIES_RULES = {
    "GAP": ("REVIEW", "gap_us > 900000000"),
    "IRREGULAR_INTERVAL": ("REJECT", "gap_us > 0 AND gap_us < 900000000"),
    "PRICE_JUMP": ("KEEP_FLAGGED", "jump"),
    "STALE_RUN": ("KEEP_FLAGGED", "stale"),
}


def _rule_sql(code: str, rules: dict, source: str) -> str:
    decision, condition = rules[code]
    return f"SELECT source_row, ts, '{code}' AS code, '{decision}' AS decision FROM {source} WHERE {condition}"


DUP_SQL = "SELECT source_row, ts, 'EXACT_DUPLICATE' AS code, 'FIX' AS decision FROM dupes WHERE dup"
CONFLICT_SQL = ("SELECT source_row, ts, 'CONFLICTING_TIMESTAMP' AS code, 'REJECT' AS decision FROM "
                "(SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM silver) WHERE n > 1")
DISORDER_SQL = ("SELECT source_row, ts, 'OUT_OF_ORDER' AS code, 'FIX' AS decision FROM "
                "(SELECT *, lag(ts) OVER (ORDER BY source_row) AS pt FROM feed) WHERE ts < pt")
ALL_FINDINGS = FEED_SQL + ", findings AS (" + " UNION ALL ".join(
    [_rule_sql(c, ROW_RULES, "feed") for c in ROW_RULES] + [_rule_sql(c, SERIES_RULES, "facts") for c in SERIES_RULES]
    + [DUP_SQL, CONFLICT_SQL, DISORDER_SQL]) + ")"


def _codes(findings: DataFrame, *codes: str) -> DataFrame:
    return findings.where(F.col("code").isin(*codes)).select("source_row", "ts", "code", "decision")


def _row_query(name: str, *codes: str):
    sql = FEED_SQL + " " + " UNION ALL ".join(_rule_sql(c, ROW_RULES, "feed") for c in codes)

    @query(name, sql)
    def build(t: Tables) -> DataFrame:
        return _codes(Q.row_findings(raw(t), META, TAU, KEYS), *codes)
    return build


def _series_query(name: str, code: str):
    @query(name, FEED_SQL + " " + _rule_sql(code, SERIES_RULES, "facts"))
    def build(t: Tables) -> DataFrame:
        return _codes(Q.series_findings(raw(t), TAU, KEYS), code)
    return build


@query("q01_bronze_source_order", "SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS source_row, event_id, ts, value FROM events")
def bronze_source_order(t: Tables) -> DataFrame:
    """Source position as stored in the file, with strict casts."""
    from_file = files.source_rows(t.spark.read.parquet(f"{t.dir}/events.parquet"))
    return from_file.select("source_row", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


@query("q01_bronze_feed", FEED_SQL + " SELECT source_row, symbol, ts, " + oracle.rs(list(Q.NUMERIC)) + " FROM feed")
def bronze_feed(t: Tables) -> DataFrame:
    return raw(t).select("source_row", "symbol", "ts", *[rounded(c).alias(c) for c in Q.NUMERIC])


@query("q02_schema_errors", FEED_SQL + """ SELECT "column", expected, actual, nulls, nulls = 0 AS passed FROM (
  SELECT 'symbol' AS "column", 'string' AS expected, 'string' AS actual, count(*) FILTER (symbol IS NULL) AS nulls FROM feed UNION ALL
  SELECT 'ts', 'timestamp', 'timestamp', count(*) FILTER (ts IS NULL) FROM feed UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', 'double', 'double', count(*) FILTER ({c} IS NULL) FROM feed" for c in Q.NUMERIC) + ")")
def schema_errors(t: Tables) -> DataFrame:
    return Q.schema_errors(raw(t))


@query("q03_local_time_guard")
def local_time_guard(t: Tables) -> DataFrame:
    """Order dates with a minute of day as New York readings: nonexistent and ambiguous ones are refused."""
    minute = F.pmod(F.col("o_orderkey"), F.lit(1440)).cast("int")
    reading = (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)).cast("timestamp")
    utc, problem = local_to_utc(reading, "America/New_York")
    rows = t.read("orders").select(utc.alias("utc"), F.coalesce(problem, F.lit("OK")).alias("problem"))
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("readings"), F.min("utc").alias("first_utc"))


_row_query("q04_nonfinite", "NONFINITE_OR_NULL")
_row_query("q05_nonpositive_price", "NONPOSITIVE_PRICE")
_row_query("q06_invalid_ohlc", "INVALID_OHLC")
_row_query("q07_spread_sign", "NEGATIVE_SPREAD", "ZERO_SPREAD")
_row_query("q08_volume_sign", "NEGATIVE_VOLUME", "NO_TICK_VOLUME")
_row_query("q09_contract_change", "SYMBOL_CHANGE", "BROKER_OR_CONTRACT_CHANGE")


@query("q10_exact_duplicate", FEED_SQL + " " + DUP_SQL)
def exact_duplicate(t: Tables) -> DataFrame:
    return _codes(Q.duplicate_findings(raw(t), KEYS), "EXACT_DUPLICATE")


@query("q11_conflicting_timestamp", FEED_SQL + " " + CONFLICT_SQL)
def conflicting(t: Tables) -> DataFrame:
    return _codes(Q.conflict_findings(raw(t), KEYS), "CONFLICTING_TIMESTAMP")


@query("q12_out_of_order", FEED_SQL + " " + DISORDER_SQL)
def disorder(t: Tables) -> DataFrame:
    return _codes(Q.disorder_findings(raw(t), KEYS), "OUT_OF_ORDER")


@query("q13_silver_sort", FEED_SQL + " SELECT source_row, ts, symbol, " + oracle.rs(["close", "spread"]) + " FROM silver ORDER BY ts, source_row")
def silver_sort(t: Tables) -> DataFrame:
    rows = Q.sorted_silver(Q.silver(raw(t), KEYS), KEYS)
    return rows.select("source_row", "ts", "symbol", rounded("close").alias("close"), rounded("spread").alias("spread"))


_series_query("q14_gap", "GAP")
_series_query("q15_irregular_interval", "IRREGULAR_INTERVAL")
_row_query("q16_off_grid_time", "OFF_GRID_TIME")
_series_query("q17_price_jump", "PRICE_JUMP")
_series_query("q18_stale_run", "STALE_RUN")
_row_query("q19_wide_spread", "WIDE_SPREAD")


@query("q20_finding_counts", ALL_FINDINGS + """ SELECT 'code' AS kind, code AS name, count(*) AS findings FROM findings GROUP BY code
  UNION ALL SELECT 'decision', decision, count(*) FROM findings GROUP BY decision""")
def counts(t: Tables) -> DataFrame:
    return Q.finding_counts(Q.findings_of(certified(t)))


@query("q21_verdict", ALL_FINDINGS + """ SELECT (SELECT count(*) FROM feed) AS input_rows, (SELECT count(*) FROM silver) AS clean_rows,
  count(DISTINCT source_row) AS flagged_rows,
  round(greatest(0.0, 100 * (1 - count(DISTINCT source_row) / (SELECT count(*) FROM feed)) - 10), 4) + 0.0::DOUBLE AS quality_score,
  CASE WHEN count(*) FILTER (decision = 'REJECT') > 0 THEN 'REJECTED' WHEN count(*) FILTER (decision = 'REVIEW') > 0
       THEN 'EXPLORATORY_ONLY' ELSE 'USABLE_WITH_LIMITATIONS' END AS status FROM findings""")
def verdict(t: Tables) -> DataFrame:
    return Q.verdict(certified(t)).select("input_rows", "clean_rows", "flagged_rows",
                                                         rounded("quality_score", 4).alias("quality_score"), "status")


@query("q22_coverage", FEED_SQL + """ SELECT round(avg((coalesce(tick_volume, -1) > 0)::INT), 6) AS tick_volume_positive,
  round(avg((coalesce(real_volume, -1) > 0)::INT), 6) AS real_volume_positive,
  round(avg((coalesce(spread, -1) = 0)::INT), 6) AS zero_spread FROM feed""")
def coverage(t: Tables) -> DataFrame:
    return raw(t).agg(rounded(share(F.col("tick_volume") > 0)).alias("tick_volume_positive"),
                      rounded(share(F.col("real_volume") > 0)).alias("real_volume_positive"),
                      rounded(share(F.col("spread") == 0)).alias("zero_spread"))


@query("q23_silver_flagged", ALL_FINDINGS + """ SELECT source_row, ts, source_row IN (SELECT source_row FROM findings) AS quality_flagged
  FROM silver""")
def flagged(t: Tables) -> DataFrame:
    return Q.flagged_silver(certified(t)).select("source_row", "ts", "quality_flagged")


@query("q24_bar_profile", FEED_SQL + """, o AS (SELECT *, lag(ts) OVER (ORDER BY source_row) AS pt,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY source_row))) / 60000000 AS m FROM feed)
SELECT count(*) AS "rows", count(*) - count(DISTINCT ts) AS duplicate_timestamps, count(*) FILTER (m < 0) AS out_of_order,
  count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR tick_volume IS NULL OR spread IS NULL OR real_volume IS NULL) AS rows_with_null,
  count(*) FILTER (ts IS NULL) AS null_ts, count(*) FILTER (open IS NULL) AS null_open, count(*) FILTER (high IS NULL) AS null_high,
  count(*) FILTER (low IS NULL) AS null_low, count(*) FILTER (close IS NULL) AS null_close, count(*) FILTER (tick_volume IS NULL) AS null_tick_volume,
  count(*) FILTER (spread IS NULL) AS null_spread, count(*) FILTER (real_volume IS NULL) AS null_real_volume,
  count(*) FILTER (NOT (low <= least(open, high, low, close) AND high >= greatest(open, high, low, close))) AS invalid_ohlc,
  count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_prices, count(*) FILTER (spread < 0) AS negative_spread,
  count(*) FILTER (spread = 0) AS zero_spread, count(*) FILTER (tick_volume < 0) AS negative_tick_volume,
  count(*) FILTER (real_volume > 0) AS real_volume_nonzero, count(*) FILTER (m > 15) AS gaps,
  round(max(CASE WHEN m > 15 THEN m END), 6) AS largest_gap_minutes,
  count(*) FILTER (m > 15 AND (m >= 1440 OR (isodow(pt) >= 5 AND isodow(ts) <= 2 AND m >= 720))) AS weekend_gaps,
  count(*) FILTER (m > 15 AND m BETWEEN 30 AND 180) AS pause_gaps, count(*) FILTER (m > 15 AND m BETWEEN 2 AND 29) AS short_gaps,
  count(*) FILTER (abs(open*100 - round_even(open*100, 0)) > 1e-7 OR abs(high*100 - round_even(high*100, 0)) > 1e-7
    OR abs(low*100 - round_even(low*100, 0)) > 1e-7 OR coalesce(abs(close*100 - round_even(close*100, 0)) > 1e-7, false)) AS digit_violations,
  count(*) FILTER (open = high AND high = low AND low = close AND tick_volume <= 1) AS synthetic_candidates,
  true AS blocking FROM o""")
def profile(t: Tables) -> DataFrame:
    return Q.bar_profile(raw(t), KEYS, TAU).drop("dataset").withColumn("largest_gap_minutes", rounded("largest_gap_minutes"))


@query("q24_gap_durations", FEED_SQL + """ SELECT floor(gap_us / 60000000)::BIGINT AS gap_minutes, count(*) AS gaps FROM facts
  WHERE gap_us > 900000000 GROUP BY 1 ORDER BY gaps DESC, gap_minutes LIMIT 15""")
def gap_durations(t: Tables) -> DataFrame:
    return Q.gap_durations(Q.silver(raw(t), KEYS), KEYS, TAU)


@query("q25_robust_jump_threshold", oracle.bars(TAU) + """, x AS (SELECT abs(close / nullif(lag(close) OVER (ORDER BY ts), 0) - 1) AS a FROM bars),
  m AS (SELECT quantile_cont(a, 0.5) AS med FROM x), d AS (SELECT quantile_cont(abs(a - med), 0.5) AS mad FROM x, m),
  t AS (SELECT med, mad, CASE WHEN mad > 0 THEN med + 20 * mad ELSE 0.05 END AS thr FROM m, d)
SELECT """ + f"{oracle.r('max(med)')} AS median, {oracle.r('max(mad)')} AS mad, {oracle.r('max(thr)')} AS threshold, " +
       "count(*) FILTER (a > thr) AS jumps FROM x, t")
def robust_jumps(t: Tables) -> DataFrame:
    halo = with_row_halo(t.bars(TAU), ["symbol"], ["bar_index"], day_chunk(), 1, ["close"])
    rows = halo.withColumn("ret", change("close", F.lag("close", 1).over(chunk_window(["symbol"], ["bar_index"])))).where(F.col(CORE))
    out = Q.robust_jump_threshold(rows, "ret")
    return out.select(rounded("median").alias("median"), rounded("mad").alias("mad"), rounded("threshold").alias("threshold"), "jumps")


@query("q26_session_completeness", oracle.bars(TAU) + """ SELECT strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS local_date, count(*) AS bars,
  count(*) < 19 AS incomplete FROM bars WHERE hour(ts - INTERVAL 285 MINUTE) * 60 + minute(ts - INTERVAL 285 MINUTE) BETWEEN 480 AND 750 GROUP BY 1""")
def completeness(t: Tables) -> DataFrame:
    days = Q.session_completeness(t.bars(TAU), "America/Bogota", TAU, 19)
    return days.withColumn("local_date", F.col("local_date").cast("string"))


@query("q27_digit_violations", """SELECT count(*) AS "rows", count(*) FILTER (abs(o_totalprice*100 - round_even(o_totalprice*100, 0)) > 1e-7) AS digit_violations,
  count(*) FILTER (abs(o_totalprice*10 - round_even(o_totalprice*10, 0)) > 1e-7) AS one_digit_violations FROM orders""")
def digits(t: Tables) -> DataFrame:
    return t.read("orders").agg(F.count(F.lit(1)).alias("rows"), count_where(Q.digit_violation(["o_totalprice"])).alias("digit_violations"),
                                count_where(Q.digit_violation(["o_totalprice"], 1)).alias("one_digit_violations"))


@query("q28_synthetic_bars", oracle.bars(1) + """ SELECT count(*) AS bars, count(*) FILTER (open = high AND high = low AND low = close
  AND tick_volume <= 1) AS synthetic_candidates FROM bars""")
def synthetic(t: Tables) -> DataFrame:
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return t.bars(1).agg(F.count(F.lit(1)).alias("bars"), count_where(flat & (F.col("tick_volume") <= 1)).alias("synthetic_candidates"))


TICKS_SQL = """WITH ticks AS (SELECT 'EVT' AS symbol, event_id AS tick_id, ts, value AS bid,
  value + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.01 AS ask, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS points FROM events)"""


@query("q29_tick_audit", TICKS_SQL + """ SELECT count(*) AS "rows", (SELECT count(*) - count(DISTINCT (ts, bid, ask)) FROM ticks) AS duplicate_ticks,
  count(*) FILTER (ts < pt) AS out_of_order, count(*) FILTER (bid <= 0 OR ask <= 0) AS nonpositive, count(*) FILTER (bid > ask) AS crossed,
  count(*) FILTER (ask - bid < 0) AS negative_spread, count(*) FILTER (points = 0) AS zero_spread, min(points) AS spread_min,
  max(points) AS spread_max, round(quantile_cont(points, 0.5), 6) AS spread_median, round(quantile_cont(points, 0.95), 6) AS spread_p95,
  count(*) FILTER (ts < pt OR bid <= 0 OR ask <= 0 OR bid > ask) > 0 AS blocking
  FROM (SELECT *, lag(ts) OVER (ORDER BY tick_id) AS pt FROM ticks)""")
def tick_audit(t: Tables) -> DataFrame:
    out = Q.tick_audit(t.ticks, ["symbol"], "tick_id").drop("symbol")
    return out.withColumn("spread_median", rounded("spread_median")).withColumn("spread_p95", rounded("spread_p95"))


@query("q30_simple_bar_check", FEED_SQL + """ SELECT count(*) AS "rows", (SELECT count(*) - count(DISTINCT ts) FROM feed) AS duplicate_timestamps,
  count(*) FILTER (m <= 0) AS unordered_pairs, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS null_rows,
  count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS invalid_ohlc, count(*) FILTER (m > 15) AS gaps,
  round(sum(CASE WHEN m > 15 THEN m / 15 - 1 ELSE 0 END), 4) AS missing_bars
  FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY source_row))) / 60000000 AS m FROM feed)""")
def simple_check(t: Tables) -> DataFrame:
    return Q.simple_bar_check(raw(t), KEYS, TAU).drop("dataset").withColumn("missing_bars", rounded("missing_bars", 4))
