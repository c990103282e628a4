"""Bar certification: row-level findings, verdict and coverage. Prices are never repaired.

Thresholds are fixed by policy. Only exact duplicates are removed and only the sort is restored; everything
else becomes a finding (source_row, ts, code, decision, detail).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barwright.functions.clock import MICROS_PER_MINUTE, local_time
from barwright.session import materialize
from barwright.functions.numeric import any_of, count_where, share, unbounded_ratio
from barwright.operators.quantiles import attach, exact_quantiles
from barwright.operators.sequence import (CHUNK, CORE, balanced_chunk, chunk_window, salted_join, with_row_halo)

PRICES = ("open", "high", "low", "close")
VOLUMES = ("tick_volume", "spread", "real_volume")
NUMERIC = PRICES + VOLUMES
REJECT, REVIEW, FIX, KEEP = "REJECT", "REVIEW", "FIX", "KEEP_FLAGGED"
JUMP_LIMIT, WIDE_LIMIT, STALE_ROWS = 0.02, 0.01, 5
BLOCK_ROWS = 1 << 20

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False), T.StructField("ts", T.TimestampType(), False),
    *[T.StructField(c, T.DoubleType(), False) for c in NUMERIC]])


def bronze(df: DataFrame, source_row: str | Column, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Source order, strict double casts (bad text raises under ANSI), string symbol."""
    row = F.col(source_row) if isinstance(source_row, str) else source_row
    rest = [c for c in df.columns if c not in ("symbol", "ts", "source_row", *columns)]
    return df.select(row.cast("bigint").alias("source_row"), F.col("symbol").cast("string").alias("symbol"),
                     F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("double").alias(c) for c in columns], *rest)


def schema_errors(df: DataFrame, expected: T.StructType = BAR_SCHEMA) -> DataFrame:
    """One row per expected column: declared type, found type, null count and whether it passes."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    present = [f for f in expected.fields if f.name in actual]
    nulls = df.agg(*[count_where(F.col(f.name).isNull()).alias(f.name) for f in present])
    facts = F.array(*[F.struct(
        F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("expected"),
        F.lit(actual.get(f.name, "MISSING")).alias("actual"),
        (F.col(f.name) if f.name in actual else F.lit(None)).cast("bigint").alias("nulls")) for f in expected.fields])
    rows = nulls.select(F.inline(facts))
    return rows.withColumn("passed", (F.col("expected") == F.col("actual")) & (F.coalesce("nulls", F.lit(1)) == 0))


def finding(condition: Column, code: str, decision: str, detail: str) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(decision).alias("decision"),
                                      F.lit(detail).alias("detail")))


def explode_findings(df: DataFrame, checks: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    listed = df.select(*keys, "source_row", "ts", F.explode(F.array_compact(F.array(*checks))).alias("_f"))
    return listed.select(*keys, "source_row", "ts", "_f.code", "_f.decision", "_f.detail")


def row_checks(meta: Mapping[str, object], minutes: int, columns: Sequence[str]) -> list[Column]:
    """Checks that need only the row itself (one projection, no shuffle)."""
    bad_number = any_of([F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in NUMERIC])
    o, h, l, c = (F.col(x) for x in PRICES)
    grid = F.pmod(F.unix_micros("ts"), F.lit(minutes * MICROS_PER_MINUTE))
    wide = unbounded_ratio(F.col("spread") * F.lit(float(meta["point"])), c) > WIDE_LIMIT
    checks = [
        finding(bad_number, "NONFINITE_OR_NULL", REJECT, "a number is absent, infinite or undefined"),
        finding(F.col("ts").isNull(), "INVALID_TIME", REJECT, "no time"),
        finding(F.least(o, h, l, c) <= 0, "NONPOSITIVE_PRICE", REJECT, "a price at or below zero"),
        finding((h < F.greatest(o, c, l)) | (l > F.least(o, c, h)), "INVALID_OHLC", REJECT, "high or low inside the body"),
        finding(F.col("spread") < 0, "NEGATIVE_SPREAD", REJECT, "ask below bid"),
        finding(F.col("spread") == 0, "ZERO_SPREAD", KEEP, "free trading is unlikely"),
        finding((F.col("tick_volume") < 0) | (F.col("real_volume") < 0), "NEGATIVE_VOLUME", REJECT, "fewer than no trades"),
        finding(F.col("tick_volume") == 0, "NO_TICK_VOLUME", KEEP, "nobody quoted"),
        finding(~F.col("symbol").eqNullSafe(F.lit(meta["symbol"])), "SYMBOL_CHANGE", REJECT, "another symbol than declared"),
        finding(grid != 0, "OFF_GRID_TIME", REVIEW, "does not start on a bar boundary"),
        finding(wide, "WIDE_SPREAD", KEEP, "spread is more than a hundredth of the price"),
    ]
    for field in ("broker", "source_id", "point"):
        if field in columns:
            checks.append(finding(~F.col(field).eqNullSafe(F.lit(meta[field])), "BROKER_OR_CONTRACT_CHANGE", REVIEW, field))
    return checks


def mark_duplicates(df: DataFrame, keys: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """True for every row equal in all source columns to an earlier one.

    The earliest row of each content group is found by partial aggregates and matched back by its own
    row number, so a group of copies of any size stays spread out.
    """
    content = [c for c in df.columns if c not in ("source_row", *keys)]
    firsts = (df.groupBy(*keys, *content).agg(F.min("source_row").alias("source_row"))
                .select(*keys, "source_row", F.lit(True).alias("_first")))
    return df.join(firsts, [*keys, "source_row"], "left").withColumn(name, F.col("_first").isNull()).drop("_first")


def mark_conflicts(df: DataFrame, keys: Sequence[str], name: str = "is_conflict") -> DataFrame:
    """True for every row of a timestamp that more than one distinct row claims."""
    crowded = df.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, "ts", F.lit(True).alias(name))
    return salted_join(df, crowded, [*keys, "ts"], "source_row").withColumn(name, F.coalesce(name, F.lit(False)))


def mark_disorder(df: DataFrame, keys: Sequence[str], name: str = "is_disorder") -> DataFrame:
    """True where time runs backwards in source order."""
    block = F.floor(F.col("source_row") / F.lit(BLOCK_ROWS)).cast("bigint")
    halo = with_row_halo(df, keys, ["source_row"], block, 1, ["ts"])
    back = F.col("ts") < F.lag("ts", 1).over(chunk_window(keys, ["source_row"]))
    return halo.withColumn(name, F.coalesce(back, F.lit(False))).where(F.col(CORE)).drop(CHUNK, CORE)


def add_neighbour_facts(silver: DataFrame, keys: Sequence[str], minutes: int) -> DataFrame:
    """Elapsed minutes, previous close, close change and the stale mark, in chronological order."""
    order = ["ts", "source_row"]
    placed = balanced_chunk(silver, keys, "ts", "source_row", minutes * MICROS_PER_MINUTE)
    halo = with_row_halo(placed, keys, order, F.col("_slab"), STALE_ROWS, ["close"])
    w = chunk_window(keys, order)
    facts = (halo.withColumn("_same", (F.col("close") == F.lag("close", 1).over(w)).cast("int"))
                 .withColumn("elapsed", (F.unix_micros("ts") - F.unix_micros(F.lag("ts", 1).over(w))) / MICROS_PER_MINUTE)
                 .withColumn("previous_ts", F.lag("ts", 1).over(w))
                 .withColumn("previous_row", F.lag("source_row", 1).over(w))
                 .withColumn("previous_close", F.lag("close", 1).over(w)))
    run = F.sum("_same").over(w.rowsBetween(1 - STALE_ROWS, 0))
    return (facts.withColumn("change", unbounded_ratio("close", "previous_close") - 1)
                 .withColumn("is_stale", F.coalesce(run == STALE_ROWS, F.lit(False)))
                 .where(F.col(CORE)).drop(CHUNK, CORE, "_same", "_slab"))


def series_rules(minutes: int) -> list[tuple[Column, str, str, str]]:
    return [
        (F.col("elapsed") > minutes, "GAP", REVIEW, "bars are missing before this one"),
        ((F.col("elapsed") > 0) & (F.col("elapsed") < minutes), "IRREGULAR_INTERVAL", REJECT, "bars overlap"),
        (F.abs(F.col("change")) > JUMP_LIMIT, "PRICE_JUMP", KEEP, "close moved by more than a fiftieth"),
        (F.col("is_stale"), "STALE_RUN", KEEP, "the close has not moved for five bars"),
    ]


def series_checks(minutes: int) -> list[Column]:
    return [finding(*rule) for rule in series_rules(minutes)]


def row_findings(df: DataFrame, meta: Mapping[str, object], minutes: int, keys: Sequence[str]) -> DataFrame:
    return explode_findings(df, row_checks(meta, minutes, df.columns), keys)


def duplicate_findings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    check = finding(F.col("is_duplicate"), "EXACT_DUPLICATE", FIX, "an earlier row says the same")
    return explode_findings(mark_duplicates(df, keys), [check], keys)


def conflict_findings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    unique = mark_duplicates(df, keys).where(~F.col("is_duplicate"))
    check = finding(F.col("is_conflict"), "CONFLICTING_TIMESTAMP", REJECT, "several rows claim this time")
    return explode_findings(mark_conflicts(unique, keys), [check], keys)


def disorder_findings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    check = finding(F.col("is_disorder"), "OUT_OF_ORDER", FIX, "earlier than the row before")
    return explode_findings(mark_disorder(df, keys), [check], keys)


def silver(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return mark_duplicates(df, keys).where(~F.col("is_duplicate")).drop("is_duplicate")


def sorted_silver(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Chronological order across and within partitions, without one global merge task."""
    order = [*keys, "ts", "source_row"]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def series_findings(df: DataFrame, minutes: int, keys: Sequence[str]) -> DataFrame:
    return explode_findings(add_neighbour_facts(silver(df, keys), keys, minutes), series_checks(minutes), keys)


def certify(df: DataFrame, meta: Mapping[str, object], minutes: int, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Bronze with a findings array per row.

    Whatever needs other rows (copies, conflicts, order, neighbours) becomes a bit set per source row, for rows with a finding only,
    joined once to the bronze rows; checks of the row itself ride along in that projection. The only table written down holds
    time and close of the distinct rows. `df` is read several times, so it should be a stored table; rows are told apart by
    (keys, source_row).
    """
    place, rules = [*keys, "source_row"], series_rules(minutes)
    content = [c for c in df.columns if c not in place]
    unique = materialize(df.groupBy(*keys, *content).agg(F.min("source_row").alias("source_row")).select(*place, "ts", "close"))

    def flags(rows: DataFrame, first: int, conditions: Sequence[Column]) -> DataFrame:
        bits = sum((F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(conditions, first)), F.lit(0))
        return rows.select(*place, bits.alias("_bits")).where("_bits > 0")

    copies = df.select(*place).join(unique.select(*place), place, "left_anti")
    parts = [flags(copies, 0, [F.lit(True)]), flags(mark_conflicts(unique, keys), 1, [F.col("is_conflict")]),
             flags(mark_disorder(df.select(*place, "ts"), keys), 2, [F.col("is_disorder")]),
             flags(add_neighbour_facts(unique, keys, minutes), 3, [condition for condition, *_ in rules])]
    bits = reduce(DataFrame.unionByName, parts).groupBy(*place).agg(F.bit_or("_bits").alias("_bits"))

    def bit(i: int) -> Column:
        return F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
    checks = row_checks(meta, minutes, df.columns) + [finding(bit(i), *named) for i, (_, *named) in enumerate(rules, 3)] + [
        finding(bit(0), "EXACT_DUPLICATE", FIX, "an earlier row says the same"),
        finding(bit(1), "CONFLICTING_TIMESTAMP", REJECT, "several rows claim this time"),
        finding(bit(2), "OUT_OF_ORDER", FIX, "earlier than the row before")]
    return df.join(bits, place, "left").select(*df.columns, bit(0).alias("is_duplicate"), F.array_compact(F.array(*checks)).alias("findings"))


def findings_of(certified: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    rows = certified.select(*keys, "source_row", "ts", F.explode("findings").alias("_f"))
    return rows.select(*keys, "source_row", "ts", "_f.code", "_f.decision", "_f.detail")


def flagged_silver(certified: DataFrame) -> DataFrame:
    """Silver rows with the quality marker: any finding of the row counts."""
    return (certified.where(~F.col("is_duplicate"))
                     .withColumn("quality_flagged", F.size("findings") > 0).drop("findings", "is_duplicate"))


def finding_counts(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by code and by decision in one pass."""
    both = findings.select(*keys, F.explode(F.array(
        F.struct(F.lit("code").alias("kind"), F.col("code").alias("name")),
        F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("name")))).alias("_x"))
    return both.groupBy(*keys, "_x.kind", "_x.name").agg(F.count(F.lit(1)).alias("findings"))


def verdict(certified: DataFrame, keys: Sequence[str] = ("dataset",), legacy: bool = False) -> DataFrame:
    """Status, descriptive score and coverage per dataset. Hard gates override the average."""
    def has(decision: str) -> Column:
        return F.exists("findings", lambda f: f["decision"] == decision)

    facts = certified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("input_rows"), count_where(~F.col("is_duplicate")).alias("clean_rows"),
        count_where(F.size("findings") > 0).alias("flagged_rows"),
        count_where(has(REJECT)).alias("_reject"), count_where(has(REVIEW)).alias("_review"),
        share(F.col("tick_volume") > 0).alias("tick_volume_positive"),
        share(F.col("real_volume") > 0).alias("real_volume_positive"),
        share(F.col("spread") == 0).alias("zero_spread"))
    score = F.greatest(F.lit(0.0), 100 * (1 - F.col("flagged_rows") / F.col("input_rows")) - 10)
    status = (F.when(F.col("_reject") > 0, F.lit("REJECTED"))
               .when((F.col("_review") > 0) | F.lit(legacy), F.lit("EXPLORATORY_ONLY"))
               .otherwise(F.lit("USABLE_WITH_LIMITATIONS")))
    return facts.withColumn("quality_score", F.round(score, 4)).withColumn("status", status).drop("_reject", "_review")


def bar_profile(bars: DataFrame, keys: Sequence[str], minutes: int) -> DataFrame:
    """Audit profile of a bar table in source order: one wide row per series."""
    block = F.floor(F.col("source_row") / F.lit(BLOCK_ROWS)).cast("bigint")
    halo = with_row_halo(bars, keys, ["source_row"], block, 1, ["ts"])
    w = chunk_window(keys, ["source_row"])
    previous = F.lag("ts", 1).over(w)
    rows = (halo.withColumn("_prev", previous)
                .withColumn("_m", (F.unix_micros("ts") - F.unix_micros(previous)) / MICROS_PER_MINUTE)
                .where(F.col(CORE)))
    gap = F.col("_m") > minutes
    # Spark day numbers: Sunday is 1, so Friday or later is 6, 7, 1 and up to Tuesday is 2, 3.
    late_week = F.dayofweek("_prev").isin(6, 7, 1)
    early_week = F.dayofweek("ts").isin(2, 3)
    weekend = gap & ((F.col("_m") >= 24 * 60) | (late_week & early_week & (F.col("_m") >= 12 * 60)))
    o, h, l, c = (F.col(x) for x in PRICES)
    invalid = ~((l <= F.least(o, h, l, c)) & (h >= F.greatest(o, h, l, c)))
    flat = (o == h) & (h == l) & (l == c) & (F.col("tick_volume") <= 1)
    per_ts = rows.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_n"))
    repeats = per_ts.groupBy(*keys).agg((F.sum("_n") - F.count(F.lit(1))).alias("duplicate_timestamps"))
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), count_where(F.col("_m") < 0).alias("out_of_order"),
        count_where(any_of([F.col(x).isNull() for x in NUMERIC])).alias("rows_with_null"),
        *[count_where(F.col(x).isNull()).alias(f"null_{x}") for x in ("ts", *NUMERIC)],
        count_where(invalid).alias("invalid_ohlc"), count_where(F.least(o, h, l, c) <= 0).alias("nonpositive_prices"),
        count_where(F.col("spread") < 0).alias("negative_spread"), count_where(F.col("spread") == 0).alias("zero_spread"),
        count_where(F.col("tick_volume") < 0).alias("negative_tick_volume"),
        count_where(F.col("real_volume") > 0).alias("real_volume_nonzero"),
        count_where(gap).alias("gaps"), F.max(F.when(gap, F.col("_m"))).alias("largest_gap_minutes"),
        count_where(weekend).alias("weekend_gaps"), count_where(gap & F.col("_m").between(30, 180)).alias("pause_gaps"),
        count_where(gap & F.col("_m").between(2, 29)).alias("short_gaps"),
        count_where(digit_violation(PRICES)).alias("digit_violations"), count_where(flat).alias("synthetic_candidates"))
    joined = facts.join(repeats, list(keys))
    blocking = any_of([F.col(x) > 0 for x in ("duplicate_timestamps", "out_of_order", "invalid_ohlc", "nonpositive_prices",
                                             "negative_spread")])
    return joined.withColumn("blocking", blocking)


def digit_violation(columns: Sequence[str], digits: int = 2) -> Column:
    scale = float(10 ** digits)
    return any_of([F.abs(F.col(c) * scale - F.rint(F.col(c) * scale)) > 1e-7 for c in columns])


def gap_durations(bars: DataFrame, keys: Sequence[str], minutes: int, top: int = 15) -> DataFrame:
    """The most frequent gap lengths; counts are aggregated before the top is taken."""
    facts = add_neighbour_facts(bars, keys, minutes).where(F.col("elapsed") > minutes)
    counted = facts.groupBy(F.floor("elapsed").cast("bigint").alias("gap_minutes")).agg(F.count(F.lit(1)).alias("gaps"))
    return counted.orderBy(F.desc("gaps"), "gap_minutes").limit(top)


def robust_jump_threshold(returns: DataFrame, value: str, factor: float = 20.0, fallback: float = 0.05) -> DataFrame:
    """Median plus `factor` median absolute deviations of absolute returns, and how many rows exceed it."""
    rows = materialize(returns.select(F.abs(F.col(value)).alias("_r")))
    median = materialize(exact_quantiles(rows, "_r", [0.5], names=["median"]))
    deviation = F.abs(F.col("_r") - F.col("median"))
    mad = exact_quantiles(attach(rows, median), deviation, [0.5], names=["mad"])
    limits = attach(median, mad).withColumn(
        "threshold", F.when(F.col("mad") > 0, F.col("median") + factor * F.col("mad")).otherwise(F.lit(fallback)))
    counted = attach(rows, limits)
    return counted.agg(F.max("median").alias("median"), F.max("mad").alias("mad"), F.max("threshold").alias("threshold"),
                       count_where(F.col("_r") > F.col("threshold")).alias("jumps"))


def session_completeness(bars: DataFrame, zone: str, minutes: int, expected: int, first: int = 480, last: int = 750) -> DataFrame:
    """In-window bars per local date and whether the session is complete."""
    local = local_time("ts", zone)
    decision = local + F.expr(f"interval {minutes} minutes")
    at = F.hour(decision) * 60 + F.minute(decision)
    inside = bars.where(at.between(first, last)).withColumn("local_date", F.to_date(local_time("ts", zone)))
    counted = inside.groupBy("local_date").agg(F.count(F.lit(1)).alias("bars"))
    return counted.withColumn("incomplete", F.col("bars") < expected)


def tick_audit(ticks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Duplicate, ordering, crossed-quote and spread statistics of a tick table in source order."""
    block = F.floor(F.col(order) / F.lit(BLOCK_ROWS)).cast("bigint")
    halo = with_row_halo(ticks, keys, [order], block, 1, ["ts"])
    back = F.col("ts") < F.lag("ts", 1).over(chunk_window(keys, [order]))
    rows = halo.withColumn("_back", F.coalesce(back, F.lit(False))).where(F.col(CORE))
    spread = F.col("ask") - F.col("bid")
    distinct = rows.groupBy(*keys, "ts", "bid", "ask").agg(F.count(F.lit(1)).alias("_n"))
    repeats = distinct.groupBy(*keys).agg((F.sum("_n") - F.count(F.lit(1))).alias("duplicate_ticks"))
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), count_where(F.col("_back")).alias("out_of_order"),
        count_where((F.col("bid") <= 0) | (F.col("ask") <= 0)).alias("nonpositive"),
        count_where(F.col("bid") > F.col("ask")).alias("crossed"), count_where(spread < 0).alias("negative_spread"),
        count_where(F.col("points") == 0).alias("zero_spread"), F.min("points").alias("spread_min"),
        F.max("points").alias("spread_max"))
    middle = exact_quantiles(ticks, "points", [0.5, 0.95], by=keys, names=["spread_median", "spread_p95"])
    out = facts.join(repeats, list(keys)).join(middle, list(keys), "left")
    return out.withColumn("blocking", any_of([F.col(x) > 0 for x in ("out_of_order", "nonpositive", "crossed")]))


def simple_bar_check(bars: DataFrame, keys: Sequence[str], minutes: int) -> DataFrame:
    """First-generation check in source order: duplicate stamps, unordered pairs, null fields, bad bounds, gaps."""
    block = F.floor(F.col("source_row") / F.lit(BLOCK_ROWS)).cast("bigint")
    halo = with_row_halo(bars, keys, ["source_row"], block, 1, ["ts"])
    previous = F.lag("ts", 1).over(chunk_window(keys, ["source_row"]))
    rows = halo.withColumn("_m", (F.unix_micros("ts") - F.unix_micros(previous)) / MICROS_PER_MINUTE).where(F.col(CORE))
    o, h, l, c = (F.col(x) for x in PRICES)
    per_ts = rows.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_n"))
    repeats = per_ts.groupBy(*keys).agg((F.sum("_n") - F.count(F.lit(1))).alias("duplicate_timestamps"))
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), count_where(F.col("_m") <= 0).alias("unordered_pairs"),
        count_where(any_of([F.col(x).isNull() for x in PRICES])).alias("null_rows"),
        count_where((h < F.greatest(o, c, l)) | (l > F.least(o, c, h))).alias("invalid_ohlc"),
        count_where(F.col("_m") > minutes).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("_m") > minutes, F.col("_m") / minutes - 1)), F.lit(0.0)).alias("missing_bars"))
    return facts.join(repeats, list(keys))
