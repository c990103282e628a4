"""Forward as-of lookup within a tolerance, without a range join and without a whole-series window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def forward_asof(targets: DataFrame, ticks: DataFrame, keys: Sequence[str], target_ts: str, tick_ts: str,
                 tiebreak: str, payload: Sequence[str], tolerance_micros: int) -> DataFrame:
    """For each distinct target time the first tick at or after it, if it comes within the tolerance.

    Time is cut into buckets as wide as the tolerance, so the answer lies in the target's own bucket or is
    the first tick of the next one. Ticks of one instant are reduced to the first before the shuffle (a
    bucket then holds at most one row per clock instant), and only the first tick of each bucket is
    copied to the bucket before it. One ordered pass per bucket resolves all its targets.
    """
    bucket = F.floor(F.col("_us") / F.lit(tolerance_micros)).cast("bigint")
    quotes = (ticks.select(*keys, F.unix_micros(tick_ts).alias("_us"), F.col(tiebreak).alias("_tie"), F.struct(*payload).alias("_q"))
                   .groupBy(*keys, "_us").agg(F.min_by("_q", "_tie").alias("_q"))
                   .withColumn("_b", bucket))
    heads = (quotes.groupBy(*keys, "_b").agg(F.min(F.struct("_us", "_q")).alias("_h"))
                   .select(*keys, F.col("_h._us").alias("_us"), F.col("_h._q").alias("_q"), (F.col("_b") - 1).alias("_b")))
    asked = (targets.select(*keys, F.unix_micros(target_ts).alias("_us")).distinct().withColumn("_b", bucket))
    quote_type = quotes.schema["_q"].dataType
    mixed = (quotes.select(*keys, "_b", "_us", "_q", F.lit(1).alias("_kind"))
             .unionByName(heads.select(*keys, "_b", "_us", "_q", F.lit(1).alias("_kind")))
             .unionByName(asked.select(*keys, "_b", "_us", F.lit(None).cast(quote_type).alias("_q"), F.lit(0).alias("_kind"))))
    seen = F.struct(F.col("_us").alias("us"), F.col("_q").alias("q"))
    backwards = Window.partitionBy(*keys, "_b").orderBy(F.desc("_us"), F.desc("_kind"))
    found = mixed.withColumn("_hit", F.last(F.when(F.col("_kind") == 1, seen), ignorenulls=True).over(
        backwards.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_kind") == 0)
    ok = F.col("_hit.us") - F.col("_us") <= tolerance_micros
    return found.select(*keys, F.timestamp_micros("_us").alias(target_ts), F.coalesce(ok, F.lit(False)).alias("valid"),
                        F.when(ok, F.timestamp_micros("_hit.us")).alias("quote_ts"),
                        *[F.when(ok, F.col("_hit.q")[c]).alias(c) for c in payload])


def potential_slippage(ticks: DataFrame, keys: Sequence[str], delays_ms: Sequence[int], tiebreak: str) -> DataFrame:
    """Absolute mid move until the first tick at or after each delay, looking ahead without a limit of rows.

    The delays become targets of one forward lookup over the mids; a delay with no later tick is NULL.
    """
    mids = ticks.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    asked = mids.select(*keys, tiebreak, "ts", "mid", F.explode(F.array(*[F.lit(d) for d in delays_ms])).alias("delay_ms"))
    asked = asked.withColumn("due", F.timestamp_micros(F.unix_micros("ts") + F.col("delay_ms") * 1000))
    reached = next_tick(asked, mids, keys, "due", "ts", tiebreak, ["mid"])
    both = asked.join(reached.withColumnRenamed("mid", "_later"), [*keys, "due"], "left")
    return both.select(*keys, tiebreak, "ts", "delay_ms", F.abs(F.col("_later") - F.col("mid")).alias("slippage"))


def next_tick(targets: DataFrame, ticks: DataFrame, keys: Sequence[str], target_ts: str, tick_ts: str, tiebreak: str,
              payload: Sequence[str], bucket_micros: int = 600_000_000) -> DataFrame:
    """First tick at or after each distinct target, however late it comes.

    As `forward_asof`, but the head of the next non-empty bucket is carried back over empty buckets; the
    table of bucket heads is bounded by the covered time span.
    """
    bucket = F.floor(F.col("_us") / F.lit(bucket_micros)).cast("bigint")
    quotes = (ticks.select(*keys, F.unix_micros(tick_ts).alias("_us"), F.col(tiebreak).alias("_tie"), F.struct(*payload).alias("_q"))
                   .groupBy(*keys, "_us").agg(F.min_by("_q", "_tie").alias("_q")).withColumn("_b", bucket))
    heads = quotes.groupBy(*keys, "_b").agg(F.min(F.struct("_us", "_q")).alias("_h"))
    asked = targets.select(*keys, F.unix_micros(target_ts).alias("_us")).distinct().withColumn("_b", bucket)
    places = (heads.select(*keys, "_b", "_h").unionByName(asked.select(*keys, "_b").distinct(), allowMissingColumns=True)
                   .groupBy(*keys, "_b").agg(F.max("_h").alias("_h")))
    later = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    entering = places.select(*keys, "_b", F.last("_h", ignorenulls=True).over(later).alias("_next")).where("_next IS NOT NULL")
    quote_type = quotes.schema["_q"].dataType
    mixed = (quotes.select(*keys, "_b", "_us", "_q", F.lit(1).alias("_kind"))
             .unionByName(entering.select(*keys, "_b", F.col("_next._us").alias("_us"), F.col("_next._q").alias("_q"), F.lit(1).alias("_kind")))
             .unionByName(asked.select(*keys, "_b", "_us", F.lit(None).cast(quote_type).alias("_q"), F.lit(0).alias("_kind"))))
    backwards = Window.partitionBy(*keys, "_b").orderBy(F.desc("_us"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_kind") == 1, F.col("_q")), ignorenulls=True).over(backwards)
    found = mixed.withColumn("_hit", hit).where(F.col("_kind") == 0)
    return found.select(*keys, F.timestamp_micros("_us").alias(target_ts), *[F.col("_hit")[c].alias(c) for c in payload])
