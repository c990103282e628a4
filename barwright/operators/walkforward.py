"""Expanding walk-forward folds, economic and opportunity campaigns, and value expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.hashing import record_hash
from barwright.functions.numeric import clamp, count_where, interval95, ratio
from barwright.operators.conditions import POLICIES, POLICY_NEEDS, learn_thresholds, magnitude_factor, policy, signal
from barwright.operators.quantiles import attach

TRAIN, TEST = "TRAIN", "TEST"


def tag_folds(df: DataFrame, time: str, first_test_year: int, purge_minutes: int, embargo_minutes: int) -> DataFrame:
    """Each row once per fold it serves, as TRAIN or TEST.

    Train ends a label horizon before 1 January of the test year, test begins an embargo after it. The
    year list is a few values computed from the time bounds; rows fan out by an array, not by a join.
    """
    roled = fold_roles(df, time, first_test_year, purge_minutes, embargo_minutes)
    both = F.concat(F.transform("train_folds", lambda y: F.struct(y.alias("fold"), F.lit(TRAIN).alias("role"))),
                    F.transform("test_folds", lambda y: F.struct(y.alias("fold"), F.lit(TEST).alias("role"))))
    return roled.select(*df.columns, F.inline(both))


def fold_roles(df: DataFrame, time: str, first_test_year: int, purge_minutes: int, embargo_minutes: int) -> DataFrame:
    """One row per row, with the folds it trains and the fold it tests as arrays (nothing fans out yet)."""
    last = df.agg(F.greatest(F.year(F.max(time)), F.lit(first_test_year)).alias("_last"))
    ts = F.col(time).cast("timestamp")
    # A row trains the folds that open after its label horizon and tests its own year once the embargo is over.
    trains_from = F.greatest(F.year(ts + F.expr(f"interval {purge_minutes} minutes")) + 1, F.lit(first_test_year))
    year = F.year(ts)
    tested = (F.year(ts - F.expr(f"interval {embargo_minutes} minutes")) == year) & (year >= first_test_year)
    none = F.array().cast("array<int>")
    return attach(df, last).select(
        *df.columns, F.when(trains_from <= F.col("_last"), F.sequence(trains_from, F.col("_last"))).otherwise(none).alias("train_folds"),
        F.when(tested, F.array(year)).otherwise(none).alias("test_folds"))


def fold_table(tagged: DataFrame, time: str) -> DataFrame:
    """Size and bounds of both segments per fold; folds with an empty segment are marked unusable."""
    out = tagged.groupBy("fold").agg(
        count_where(F.col("role") == TRAIN).alias("train_rows"), count_where(F.col("role") == TEST).alias("test_rows"),
        F.max(F.when(F.col("role") == TRAIN, F.col(time))).alias("train_last"), F.min(F.when(F.col("role") == TEST, F.col(time))).alias("test_first"),
        F.max(F.when(F.col("role") == TEST, F.col(time))).alias("test_last"))
    return out.withColumn("usable", (F.col("train_rows") > 0) & (F.col("test_rows") > 0))


def overlap_violations(folds: DataFrame, purge_minutes: int) -> DataFrame:
    """Folds whose last training label reaches the first test row."""
    reach = F.col("train_last").cast("timestamp") + F.expr(f"interval {purge_minutes} minutes")
    return folds.withColumn("overlaps", F.coalesce(reach >= F.col("test_first").cast("timestamp"), F.lit(False)))


def temporal_parts(df: DataFrame, time: str, by: Sequence[str], shares: Sequence[float] = (0.70, 0.85)) -> DataFrame:
    """FIT, STOP and CALIBRATE by time order. Cut points come from counts per instant, rows are only compared with them."""
    per = df.groupBy(*by, time).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*by).orderBy(time)
    cum = per.withColumn("_upto", F.sum("_n").over(along)).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    first = F.greatest(F.lit(1), F.floor(F.col("_total") * shares[0]))
    second = F.greatest(first + 1, F.floor(F.col("_total") * shares[1]))
    before = F.col("_upto") - F.col("_n")
    # An instant belongs to the part its first row falls into.
    part = F.when(before < first, F.lit("FIT")).when(before < second, F.lit("STOP")).otherwise(F.lit("CALIBRATE"))
    return df.join(cum.select(*by, time, part.alias("part")), [*by, time])


def signal_rows(rows: DataFrame, signals: Sequence[Mapping], outcome: Mapping[str, str]) -> DataFrame:
    """Rows that fire each frozen signal, with the outcome columns of its action and horizon."""
    listed = []
    for s in signals:
        fields = {name: F.col(pattern.format(action=s["action"].lower(), horizon=s["horizon"])) for name, pattern in outcome.items()}
        listed.append(F.when(signal(s), F.struct(F.lit(s["id"]).alias("signal"), signal(s, magnitude_factor(s)).alias("stronger"),
                                                 *[v.alias(k) for k, v in fields.items()])))
    return rows.select(*rows.columns, F.inline(F.array_compact(F.array(*listed))))


def test_rows(rows: DataFrame) -> DataFrame:
    """Rows with the one fold they test."""
    kept = [c for c in rows.columns if c not in ("train_folds", "test_folds")]
    return rows.where(F.size("test_folds") > 0).select(*kept, F.get("test_folds", 0).alias("fold"))


def policy_flags(fired: DataFrame, signals: Sequence[Mapping], policies: Sequence[str] = POLICIES) -> DataFrame:
    """Test rows of every signal with one flag per policy, ENTER or WAIT, thresholds learned per signal and fold.

    One row per (row, signal), however many policies there are: `by_policy` spreads them where they are aggregated. One job for all policies: thresholds are a table of (signals x folds) rows, which is broadcast.
    """
    learned = learn_thresholds(fired, POLICY_NEEDS, by=["signal"], fan="train_folds")
    test = test_rows(fired).join(F.broadcast(learned), ["signal", "fold"], "left")
    by_signal = {s["id"]: s for s in signals}

    def entered(name: str) -> Column:
        if name != "HIGH_SIGNAL_MAGNITUDE":
            return policy(name, signals[0])
        out = F.lit(False)
        for sid, s in by_signal.items():
            out = F.when(F.col("signal") == sid, policy(name, s)).otherwise(out)
        return out
    thresholds = [c for c in learned.columns if c not in ("signal", "fold")]
    return test.withColumn("flags", F.array(*[entered(p) for p in policies])).drop(*thresholds)


def by_policy(flags: DataFrame, policies: Sequence[str] = POLICIES) -> DataFrame:
    """One row per policy, for an aggregate to consume in the same stage."""
    listed = F.array(*[F.struct(F.lit(p).alias("policy"), F.get("flags", F.lit(i)).alias("entered")) for i, p in enumerate(policies)])
    return flags.select(*[c for c in flags.columns if c != "flags"], F.inline(listed))


def fold_results(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    return entries.groupBy(*by, "fold").agg(
        F.count(F.lit(1)).alias("eligible"), count_where(F.col("entered")).alias("entered"), count_where(~F.col("entered")).alias("waited"),
        F.avg(F.when(F.col("entered"), F.col("net"))).alias("expected_net"))


def policy_results(entries: DataFrame, by: Sequence[str], time: str, multipliers: Sequence[float], session: str = "session_id") -> DataFrame:
    """Rates, support, hit rate, payoff and cost stress per group (all groups in one aggregate)."""
    on, net, gross, cost = F.col("entered"), F.col("net"), F.col("gross"), F.col("cost")

    def when(x: Column) -> Column:
        return F.when(on, x)
    per_session = entries.where(on).groupBy(*by, session).agg(F.lit(1).alias("_one"))
    sessions = per_session.groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"))
    per_year = entries.where(on).groupBy(*by, F.year(time).alias("_y")).agg(F.avg("net").alias("_m"))
    years = per_year.groupBy(*by).agg(F.count(F.lit(1)).alias("years"), count_where(F.col("_m") > 0).alias("positive_years"))
    facts = entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("eligible"), count_where(on).alias("entered"), F.avg(when(net)).alias("expected_net"),
        F.avg(when(gross)).alias("break_even_cost"), F.avg(when(cost)).alias("expected_cost"),
        F.avg(when((net > 0).cast("double"))).alias("hit_rate"),
        ratio(F.avg(when(F.when(net > 0, net))), F.abs(F.avg(when(F.when(net < 0, net))))).alias("payoff"),
        F.avg(when(F.col("mfe"))).alias("mfe"), F.avg(when(F.col("mae"))).alias("mae"),
        *[F.avg(when(gross - float(m) * cost)).alias(f"stress_{str(m).replace('.', '_')}") for m in multipliers])
    out = facts.join(sessions, list(by), "left").join(years, list(by), "left").na.fill(0, ["sessions", "years", "positive_years"])
    return (out.withColumn("waited", F.col("eligible") - F.col("entered")).withColumn("entry_rate", ratio("entered", "eligible"))
               .withColumn("cost_to_gross", ratio("expected_cost", F.abs("break_even_cost")))
               .withColumn("stable", (F.col("years") >= 3) & (F.col("positive_years") >= F.greatest(F.lit(2), F.col("years") - 1))))


def trade_value(rows: DataFrame, by: Sequence[str], gross: str, cost: str, action: str, minimum: int) -> DataFrame:
    """Mean net value with a normal interval and the ENTER or WAIT decision."""
    net = F.col(gross) - F.col(cost)
    n = F.count(net)
    facts = rows.groupBy(*by).agg(n.alias("support"), F.avg(F.when(net.isNotNull(), F.col(gross))).alias("expected_gross"),
                                  F.avg(F.when(net.isNotNull(), F.col(cost))).alias("expected_cost"), F.avg(net).alias("expected_net"),
                                  F.when(n > 1, F.stddev_samp(net) / F.sqrt(n)).alias("uncertainty"))
    low, high = interval95("expected_net", "uncertainty")
    out = facts.withColumn("ci_low", low).withColumn("ci_high", high)
    enter = (F.col("support") >= minimum) & (F.coalesce(F.col("ci_low"), F.lit(0.0)) > 0)
    return out.withColumn("decision", F.when(enter, F.lit(f"ENTER_{action}")).otherwise(F.lit("WAIT")))


def abstention(df: DataFrame, value: str = "expected_net", wait: float = 0.0) -> DataFrame:
    """Gain of waiting over entering; an absent value never enters."""
    gain = F.lit(wait) - F.col(value)
    return df.withColumn("abstention_value", gain).withColumn(
        "optimal_action", F.when(F.coalesce(gain >= 0, F.lit(True)), F.lit("WAIT")).otherwise(F.lit("ENTER")))


def edge_to_cost(move, cost) -> Column:
    return ratio(move, F.when(F.col(cost) > 0, F.col(cost)) if isinstance(cost, str) else F.when(cost > 0, cost))


def opportunity_value(move: str, cost: str, frequency: str, uncertainty: str, complexity: str) -> Column:
    materiality = F.least(F.lit(1.0), edge_to_cost(move, cost) / 3.0)
    often = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(frequency)) / 0.10)
    precision = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.col(uncertainty) / 0.25))
    return F.greatest(F.lit(0.0), 0.45 * materiality + 0.25 * often + 0.2 * precision - 0.08 * F.col(complexity))


def opportunity_labels(df: DataFrame, horizon: int, k: float, horizons: Sequence[int], cost: str) -> DataFrame:
    """Largest absolute excursion, whether it covers k costs, the surplus and the first horizon that hits."""
    size = {h: F.greatest(F.abs(F.col(f"label_up_{h}")), F.abs(F.col(f"label_down_{h}"))) for h in horizons if h <= horizon}
    need = F.lit(float(k)) * F.col(cost)
    large = F.coalesce(size[horizon] >= need, F.lit(False))
    first = F.lit(None).cast("int")
    for h in sorted(size, reverse=True):
        first = F.when(F.coalesce(size[h] >= need, F.lit(False)), F.lit(h)).otherwise(first)
    return df.withColumns({"max_excursion": size[horizon], "large": large, "surplus": size[horizon] - need, "time_to_excursion": first})


# ---- catalogue ranking -------------------------------------------------------------------------------

# Component weights of the research priority: fixed values.
PRIORITY_GAINS = {"information_gain": 0.22, "uncertainty_reduction": 0.16, "novelty": 0.13, "contradiction": 0.12, "economic": 0.12, "data_quality": 0.10}
PRIORITY_PENALTIES = {"redundancy": 0.45, "saturation": 0.30, "complexity": 0.25}


def research_priority() -> Column:
    """Clamped weighted gain, lowered by redundancy, saturated families and complexity."""
    gain = sum((w * clamp(c, 0.0, 1.0) for c, w in PRIORITY_GAINS.items()), F.lit(0.0))
    gain = gain + 0.08 * (1 - clamp("prior_evidence", 0.0, 1.0)) + 0.07 * (1 - clamp("compute_cost", 0.0, 1.0))
    penalty = sum((w * clamp(c, 0.0, 1.0) for c, w in PRIORITY_PENALTIES.items()), F.lit(0.0))
    return F.round(clamp(gain * (1 - 0.7 * penalty), 0.0, 1.0), 6)


def rank_candidates(candidates: DataFrame, registry: DataFrame, signature: Sequence[str], limit: int) -> DataFrame:
    """Drop candidates whose signature is registered, saturate rejected families, score and keep the best."""
    named = candidates.withColumn("signature", record_hash("SIG", signature))
    known = registry.withColumn("signature", record_hash("SIG", signature)).select("signature").distinct()
    rejected = registry.where(F.col("status") == "REJECTED").groupBy("family").agg(F.count(F.lit(1)).alias("_rejected"))
    fresh = named.join(known, "signature", "left_anti").join(rejected, "family", "left")
    scored = fresh.withColumn("saturation", F.least(F.lit(1.0), F.coalesce("_rejected", F.lit(0)) / 4)).withColumn("score", research_priority())
    return scored.drop("_rejected").orderBy(F.desc("score"), "id").limit(limit)


def consolidate(results: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Verdict counts per family as columns."""
    return results.groupBy("family").pivot("status", list(statuses)).agg(F.count(F.lit(1))).na.fill(0)
