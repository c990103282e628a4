"""Integrity diagnostics of certified bars and comparison with an independent source.

Causes are never asserted: gaps and stale runs are described, compared and left for review.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.clock import MICROS_PER_MINUTE, bar_index, plus_minutes
from barwright.functions.numeric import change, count_where, ratio
from barwright.operators.quality import add_neighbour_facts
from barwright.operators.quantiles import exact_quantiles
from barwright.operators.sequence import islands

# Clock pairs that recur around session closes: fixed values.
RECURRING_PAIRS = (("23:58", "01:00"), ("22:58", "00:00"), ("00:13", "01:00"), ("23:13", "00:00"))


def gap_table(facts: DataFrame, minutes: int) -> DataFrame:
    """One row per gap with its morphology. `facts` carries elapsed minutes and the previous row."""
    left, right = F.col("previous_ts"), F.col("ts")
    # Monday is 0: counting on from the left weekday reaches Saturday (5) inside the span.
    touches_weekend = F.weekday(left) + F.datediff(right, left) >= 5
    morphology = (F.when(touches_weekend, F.lit("WEEKEND_SPANNING"))
                   .when(F.to_date(left) != F.to_date(right), F.lit("CROSS_DATE")).otherwise(F.lit("INTRADAY")))
    return (facts.where(F.col("elapsed") > minutes)
                 .select("source_row", "previous_row", left.alias("previous_ts"), right.alias("next_ts"),
                         F.col("elapsed").alias("elapsed_minutes"),
                         (F.col("elapsed") / minutes - 1).alias("absent_bars"),
                         F.date_format(left, "HH:mm").alias("previous_clock"), F.date_format(right, "HH:mm").alias("next_clock"),
                         F.date_format(left, "EEEE").alias("previous_weekday"), F.date_format(right, "EEEE").alias("next_weekday"),
                         morphology.alias("morphology"), F.lit("UNRESOLVED").alias("cause")))


def anomaly_rows(findings: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings with the bar they point at, its elapsed time, previous close and close change."""
    bars = facts.select(*keys, "source_row", "elapsed", "previous_close", "change", "close")
    return findings.join(bars, [*keys, "source_row"], "left")


def stale_episodes(facts: DataFrame, keys: Sequence[str], chunk: Column, minutes: int) -> DataFrame:
    """Runs of equal closes that hold at least one stale mark."""
    begins = ~F.coalesce(F.col("close") == F.col("previous_close"), F.lit(False))
    runs = islands(facts, keys, ["ts", "source_row"], chunk, begins, "run_start")
    edge = (F.col("ts") > F.col("run_start")) & (F.col("elapsed") > minutes)
    return (runs.groupBy(*keys, "run_start")
                .agg(F.max("ts").alias("run_end"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"),
                     F.count(F.lit(1)).alias("bars"), count_where(F.col("is_stale")).alias("alerts"),
                     F.min_by("close", "ts").alias("close"), count_where(edge).alias("gap_edges"),
                     count_where(F.col("high") != F.col("low")).alias("nonflat_bars"),
                     count_where(F.col("tick_volume") > 0).alias("positive_tick_bars"))
                .where(F.col("alerts") > 0))


def segments(facts: DataFrame, flagged: DataFrame, keys: Sequence[str], chunk: Column, minutes: int) -> DataFrame:
    """Contiguous blocks of bars with the number of flagged rows in each."""
    begins = ~F.coalesce(F.col("elapsed") == minutes, F.lit(False))
    runs = islands(facts, keys, ["ts", "source_row"], chunk, begins, "segment_start")
    marks = flagged.select(*keys, "source_row").distinct().withColumn("_flag", F.lit(1))
    return (runs.join(marks, [*keys, "source_row"], "left").groupBy(*keys, "segment_start")
                .agg(F.max("ts").alias("segment_end"), F.count(F.lit(1)).alias("rows"), F.min("source_row").alias("first_row"),
                     F.max("source_row").alias("last_row"), F.count("_flag").alias("flagged_rows")))


def reconcile(recorded: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per code: how many recorded and recomputed marks agree. One union and two aggregates, no join."""
    both = (recorded.select(*keys, "source_row", "code", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(recomputed.select(*keys, "source_row", "code", F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    per_row = both.groupBy(*keys, "source_row", "code").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return per_row.groupBy("code").agg(
        F.sum("_a").alias("recorded"), F.sum("_b").alias("recomputed"),
        count_where(F.col("_a") > F.col("_b")).alias("missing"), count_where(F.col("_b") > F.col("_a")).alias("extra"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("morphology").agg(F.count(F.lit(1)).alias("gaps"), F.sum("absent_bars").alias("absent_bars"))


def integrity_summary(facts: DataFrame, gaps: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row: totals that tie the diagnostic tables together."""
    a = facts.agg(F.count(F.lit(1)).alias("rows"), count_where(F.col("spread") == 0).alias("zero_spread_rows"))
    b = gaps.agg(F.count(F.lit(1)).alias("gaps"), F.coalesce(F.sum("absent_bars"), F.lit(0.0)).alias("absent_bars"))
    c = episodes.agg(F.count(F.lit(1)).alias("stale_episodes"), count_where(F.col("gap_edges") > 0).alias("stale_crossing_gaps"),
                     F.coalesce(F.sum("nonflat_bars"), F.lit(0)).alias("stale_nonflat_bars"))
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").join(c.select("*", one), "_one").drop("_one")


def gap_triage(gaps: DataFrame, short_minutes: Sequence[int], pairs: Sequence[tuple[str, str]] = RECURRING_PAIRS) -> DataFrame:
    """Descriptive grouping of gaps after observation; later rules win over earlier ones."""
    listed = F.array(*[F.lit(f"{a}>{b}") for a, b in pairs])
    recurring = F.array_contains(listed, F.concat_ws(">", "previous_clock", "next_clock"))
    short = (F.col("morphology") == "INTRADAY") & F.col("elapsed_minutes").isin(*[float(m) for m in short_minutes])
    triage = (F.when(F.col("morphology") == "WEEKEND_SPANNING", F.lit("WEEKEND_CLOSURE_CANDIDATE_UNVERIFIED"))
               .when(recurring, F.lit("RECURRING_SESSION_PATTERN_UNVERIFIED"))
               .when(short, F.lit("SHORT_INTRADAY_UNRESOLVED")).otherwise(F.lit("OTHER_UNRESOLVED")))
    return gaps.withColumn("triage", triage)


def source_profile(facts: DataFrame, minutes: int, period: Column, keys: Sequence[str]) -> DataFrame:
    """Yearly profile of an external source: findings, gaps and 24-hour coverage of the calendar year."""
    per_ts = facts.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_n"))
    crowded = per_ts.where("_n > 1").groupBy(period.alias("year")).agg(F.sum("_n").alias("duplicate_timestamp_rows"))
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rows = facts.groupBy(period.alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), count_where(F.least(o, h, l, c) <= 0).alias("nonpositive_price"),
        count_where((h < F.greatest(o, c, l)) | (l > F.least(o, c, h))).alias("invalid_ohlc"),
        count_where(F.pmod(F.unix_micros("ts"), F.lit(minutes * MICROS_PER_MINUTE)) != 0).alias("off_grid"),
        count_where(F.abs(F.col("change")) > 0.02).alias("price_jump"), count_where(F.col("is_stale")).alias("stale_run"),
        count_where(F.col("elapsed") > minutes).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("elapsed") > minutes, F.col("elapsed") / minutes - 1)), F.lit(0.0)).alias("absent_bars"),
        F.count_distinct(F.to_date("ts")).alias("days"))
    out = rows.join(crowded, "year", "left").withColumn("duplicate_timestamp_rows", F.coalesce("duplicate_timestamp_rows", F.lit(0)))
    whole = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date(F.col("year"), F.lit(1), F.lit(1))) * 1440 / minutes
    return out.withColumn("coverage_24h", F.col("rows") / whole)


def clock_offset_scan(ours: DataFrame, other: DataFrame, minutes: int, hours: Sequence[int], month: Column) -> DataFrame:
    """Compare two sources under every whole-hour clock shift, overall and per month.

    The hours are an array on our side (no cross join); the shifted clock is an equi-join key that is
    unique per side and shift. The result scores every shift; which one holds is for the reader to judge.
    """
    per_hour = 60 // minutes if minutes <= 60 else 1 / (minutes / 60)
    a = (ours.select("bar_index", month.alias("month"), *[F.col(c).alias(f"a_{c}") for c in ("open", "high", "low", "close")])
             .withColumn("hours", F.explode(F.array(*[F.lit(h) for h in hours])))
             .withColumn("_key", (F.col("bar_index") - F.col("hours") * F.lit(int(per_hour))).cast("bigint")))
    b = other.select(F.col("bar_index").alias("_key"), *[F.col(c).alias(f"b_{c}") for c in ("open", "high", "low", "close")])
    diffs = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in ("open", "high", "low", "close")]
    matched = a.join(b, "_key").select("hours", F.explode(F.array(F.lit("ALL"), F.col("month"))).alias("period"),
                                       F.array(*diffs).alias("_d"))
    exact = F.forall("_d", lambda x: x == 0)
    summary = matched.groupBy("hours", "period").agg(
        F.count(F.lit(1)).alias("matched_bars"), F.avg(F.aggregate("_d", F.lit(0.0), lambda s, x: s + x) / 4).alias("mean_abs_ohlc"),
        count_where(exact).alias("exact_bars"))
    # All four differences and, apart from them, the close alone: one quantile pass serves both.
    listed = F.concat(F.transform("_d", lambda x: F.struct(F.lit("OHLC").alias("kind"), x.alias("x"))),
                      F.array(F.struct(F.lit("CLOSE").alias("kind"), F.col("_d")[3].alias("x"))))
    values = matched.select("hours", "period", F.inline(listed))
    q = exact_quantiles(values, "x", [0.5, 0.95], by=["hours", "period", "kind"], names=["median", "p95"], few_groups=True)
    spread = q.groupBy("hours", "period").agg(
        F.max(F.when(F.col("kind") == "OHLC", F.col("median"))).alias("median_abs_ohlc"), F.max(F.when(F.col("kind") == "OHLC", F.col("p95"))).alias("p95_abs_ohlc"),
        F.max(F.when(F.col("kind") == "CLOSE", F.col("median"))).alias("median_abs_close"))
    return summary.join(spread, ["hours", "period"])


def expand_to_grid(intervals: DataFrame, start: str, end: str, minutes: int, inclusive: bool) -> DataFrame:
    """One row per grid bar of each interval, so that an interval join becomes an equi-join on the bar."""
    first = bar_index(start, minutes)
    first = F.when(F.pmod(F.unix_micros(start), F.lit(minutes * MICROS_PER_MINUTE)) == 0, first).otherwise(first + 1)
    last = bar_index(end, minutes)
    if not inclusive:
        last = F.when(F.pmod(F.unix_micros(end), F.lit(minutes * MICROS_PER_MINUTE)) == 0, last - 1).otherwise(last)
    grid = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return intervals.withColumn("_grid", F.explode_outer(grid))


def gap_presence(gaps: DataFrame, other: DataFrame, minutes: int, hours: Sequence[int]) -> DataFrame:
    """How many bars of the other source fall inside each of our gaps, for some clock shifts."""
    shifted = (gaps.select("source_row", "previous_ts", "next_ts", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hours"))
                   .withColumn("start", plus_minutes("previous_ts", F.lit(minutes) - F.col("hours") * 60))
                   .withColumn("end_exclusive", plus_minutes("next_ts", -F.col("hours") * 60)))
    grid = expand_to_grid(shifted, "start", "end_exclusive", minutes, False)
    bars = other.select(F.col("bar_index").alias("_grid"), F.lit(1).alias("_there"))
    counted = grid.join(bars, "_grid", "left").groupBy("source_row", "hours", "start", "end_exclusive").agg(
        F.count("_grid").alias("absent_bars"), F.count("_there").alias("present_bars"))
    relation = (F.when(F.col("present_bars") == F.col("absent_bars"), F.lit("ALL_PRESENT"))
                 .when(F.col("present_bars") == 0, F.lit("ALL_ABSENT")).otherwise(F.lit("PARTIAL")))
    return counted.withColumn("relation", relation)


def window_profile(windows: DataFrame, other: DataFrame, minutes: int, hours: Sequence[int]) -> DataFrame:
    """What the other source shows inside labelled windows (inclusive ends) under each clock shift."""
    shifted = (windows.select("label", "start_ts", "end_ts", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hours"))
                      .withColumn("start", plus_minutes("start_ts", -F.col("hours") * 60))
                      .withColumn("end", plus_minutes("end_ts", -F.col("hours") * 60)))
    grid = expand_to_grid(shifted, "start", "end", minutes, True)
    bars = other.select(F.col("bar_index").alias("_grid"), "close", "change", "is_stale", (F.col("high") != F.col("low")).alias("_nonflat"))
    return (grid.join(bars, "_grid", "left").groupBy("label", "hours", "start", "end")
                .agg(F.count("_grid").alias("expected_bars"), F.count("close").alias("bars"),
                     F.count_distinct("close").alias("distinct_closes"), count_where(F.col("is_stale")).alias("stale_alerts"),
                     count_where(F.abs(F.col("change")) > 0.02).alias("jump_alerts"), F.min("change").alias("min_return"),
                     count_where(F.col("_nonflat")).alias("nonflat_bars"))
                .withColumn("missing_bars", F.col("expected_bars") - F.col("bars")))


def coverage_by_period(ours: DataFrame, other: DataFrame, period: Column) -> DataFrame:
    """Bars of both sources per period and the number of timestamps they share."""
    a = ours.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("our_bars"), F.min("ts").alias("our_first"), F.max("ts").alias("our_last"))
    b = other.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("other_bars"))
    both = ours.join(other.select("ts"), "ts", "left_semi").groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("matching"))
    out = a.join(b, "period", "full").join(both, "period", "left")
    return out.na.fill(0, ["our_bars", "other_bars", "matching"])
