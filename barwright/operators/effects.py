"""Session-level conditional effects. Row data is reduced to one row per hypothesis and session, map-side first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.numeric import count_where, interval95, p_positive, ratio

MIN_PAIRED = 20


def stack_hypotheses(df: DataFrame, specs: Sequence[tuple[str, Column, Column]], keep: Sequence[str]) -> DataFrame:
    """One scan for many hypotheses: a row per (row, hypothesis) with condition and value; NULL values drop out."""
    packed = F.array(*[F.struct(F.lit(name).alias("hypothesis"), mask.alias("condition"), value.cast("double").alias("value"))
                       for name, mask, value in specs])
    return df.select(*keep, F.inline(packed)).where(F.col("value").isNotNull())


def session_means(rows: DataFrame, by: Sequence[str], session: str = "session_id") -> DataFrame:
    """Mean under the condition and under its complement, per session."""
    return rows.groupBy(*by, session).agg(
        F.avg(F.when(F.col("condition"), F.col("value"))).alias("conditioned"),
        F.avg(F.when(~F.col("condition"), F.col("value"))).alias("baseline"),
        F.count(F.lit(1)).alias("rows"))


def effect_summary(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """Paired effect when enough sessions have both sides, otherwise the difference of group means."""
    both = F.col("conditioned").isNotNull() & F.col("baseline").isNotNull()
    facts = means.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions_seen"), count_where(both).alias("paired_sessions"),
        F.count("conditioned").alias("conditioned_sessions"), F.count("baseline").alias("baseline_sessions"),
        F.avg(F.when(both, F.col("conditioned") - F.col("baseline"))).alias("_pair"),
        F.avg(F.when(both, F.col("conditioned"))).alias("_pc"), F.avg(F.when(both, F.col("baseline"))).alias("_pb"),
        F.avg("conditioned").alias("_c"), F.avg("baseline").alias("_b"), F.sum("rows").alias("rows"))
    paired = F.col("paired_sessions") >= F.greatest(F.lit(MIN_PAIRED), F.floor(F.col("sessions_seen") * 0.25))
    return (facts.withColumn("paired", paired)
                 .withColumn("effect", F.when(F.col("paired"), F.col("_pair")).otherwise(F.col("_c") - F.col("_b")))
                 .withColumn("conditioned_mean", F.when(F.col("paired"), F.col("_pc")).otherwise(F.col("_c")))
                 .withColumn("baseline_mean", F.when(F.col("paired"), F.col("_pb")).otherwise(F.col("_b")))
                 .withColumn("sessions", F.when(F.col("paired"), F.col("paired_sessions"))
                             .otherwise(F.col("conditioned_sessions") + F.col("baseline_sessions")))
                 .drop("_pair", "_pc", "_pb", "_c", "_b"))


def influence(means: DataFrame, summary: DataFrame, by: Sequence[str], session: str = "session_id") -> DataFrame:
    """The effect sample: pair differences, or both groups centred on the other group's mean."""
    facts = summary.select(*by, "paired", "conditioned_mean", "baseline_mean")
    rows = means.join(facts, list(by))
    parts = F.when(F.col("paired"), F.array(F.struct(F.lit("PAIR").alias("side"), (F.col("conditioned") - F.col("baseline")).alias("effect")))
                   ).otherwise(F.array(
                       F.struct(F.lit("CONDITIONED").alias("side"), (F.col("conditioned") - F.col("baseline_mean")).alias("effect")),
                       F.struct(F.lit("BASELINE").alias("side"), (F.col("conditioned_mean") - F.col("baseline")).alias("effect"))))
    return rows.select(*by, session, F.inline(parts)).where(F.col("effect").isNotNull())


def paired_effects(means: DataFrame, by: Sequence[str], session: str = "session_id") -> DataFrame:
    """Strict form for a fixed condition: only sessions with both sides."""
    return (means.where(F.col("conditioned").isNotNull() & F.col("baseline").isNotNull())
                 .select(*by, session, (F.col("conditioned") - F.col("baseline")).alias("effect"), "conditioned", "baseline"))


def require_pairs(effects: DataFrame, by: Sequence[str], minimum: int = MIN_PAIRED) -> DataFrame:
    """Mean paired effect, or NULL with a reason when fewer than the required sessions pair up."""
    facts = effects.groupBy(*by).agg(F.count(F.lit(1)).alias("paired_sessions"), F.avg("effect").alias("_e"))
    enough = F.col("paired_sessions") >= minimum
    return (facts.withColumn("effect", F.when(enough, F.col("_e")))
                 .withColumn("status", F.when(enough, F.lit("OK")).otherwise(F.lit("INSUFFICIENT_PAIRED_SESSIONS"))).drop("_e"))


def support(rows: DataFrame, by: Sequence[str], mask: Column, year: Column, minima: Mapping[str, int],
            session: str = "session_id") -> DataFrame:
    """Rows, sessions and years under the condition against their minima."""
    facts = rows.where(mask).groupBy(*by).agg(
        F.count(F.lit(1)).alias("condition_rows"), F.count_distinct(session).alias("condition_sessions"),
        F.count_distinct(year).alias("condition_years"))
    passed = ((F.col("condition_rows") >= minima["rows"]) & (F.col("condition_sessions") >= minima["sessions"])
              & (F.col("condition_years") >= minima["years"]))
    return facts.withColumn("passed", passed)


def base_rates(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Plain means: conditioned, complement and all rows."""
    return rows.groupBy(*by).agg(F.avg(F.when(F.col("condition"), F.col("value"))).alias("conditioned"),
                                 F.avg(F.when(~F.col("condition"), F.col("value"))).alias("baseline"),
                                 F.avg("value").alias("full"))


def rate_lift(rows: DataFrame, by: Sequence[str], selected: Column, hit: Column, session: str = "session_id") -> DataFrame:
    """Per-session rate in the selection minus the rate in all rows, with a normal interval.

    Selection and baseline come from the same scan: one aggregate per session holds both rates.
    """
    flag = hit.cast("double")
    per = rows.groupBy(*by, session).agg(F.avg(F.when(selected, flag)).alias("_a"), F.avg(flag).alias("_b"))
    x = F.col("_a") - F.col("_b")
    facts = per.groupBy(*by).agg(F.count(x).alias("sessions"), F.avg(x).alias("lift"), F.stddev_samp(x).alias("_sd"))
    error = ratio("_sd", F.sqrt("sessions"))
    low, high = interval95("lift", "se")
    return (facts.withColumn("se", F.when(F.col("sessions") >= 2, error)).withColumn("ci_low", low).withColumn("ci_high", high)
                 .withColumn("p_value", F.when(F.col("sessions") < 2, F.lit(1.0)).otherwise(p_positive("lift", "se"))).drop("_sd"))


def clustered_mean(rows: DataFrame, by: Sequence[str], value: str, session: str = "session_id") -> DataFrame:
    """Row mean with a session-clustered (sandwich) standard error and 95% interval.

    Sum of squared influences expands to per-session sums, so one aggregate by session and one by
    group suffice and no global mean has to be sent back to the rows.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, session).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return clustered_sessions(per, by)


def clustered_sessions(per: DataFrame, by: Sequence[str]) -> DataFrame:
    """`clustered_mean` from one row per group and session with the sum and the count of the value (_s, _n)."""
    facts = per.groupBy(*by).agg(
        F.sum("_s").alias("_S"), F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("clusters"),
        F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum(F.col("_s") * F.col("_n")).alias("_sn"),
        F.sum((F.col("_n") * F.col("_n")).cast("double")).alias("_nn"))
    mean = ratio("_S", "rows")
    squares = F.greatest(F.col("_ss") - 2 * F.col("mean") * F.col("_sn") + F.col("mean") * F.col("mean") * F.col("_nn"), F.lit(0.0))
    error = F.when((F.col("clusters") > 1) & (F.col("rows") > 1),
                   F.sqrt(squares * F.col("clusters") / (F.col("clusters") - 1)) / F.col("rows"))
    low, high = interval95("mean", "se")
    return (facts.withColumn("mean", mean).withColumn("se", error).withColumn("ci_low", low).withColumn("ci_high", high)
                 .withColumn("p_value", p_positive("mean", "se")).drop("_S", "_ss", "_sn", "_nn"))
