"""Stability, stress and falsification of effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.numeric import count_where, failed_names, ratio
from barwright.operators.quantiles import exact_quantiles


def period_rows(rows: DataFrame, time: str) -> DataFrame:
    """Each row once for its year and once for its half-year."""
    year = F.year(time).cast("string")
    half = F.concat(year, F.when(F.month(time) <= 6, F.lit("-H1")).otherwise(F.lit("-H2")))
    return rows.withColumn("period", F.explode(F.array(year, half)))


def sign_summary(effects: DataFrame, by: Sequence[str], effect: str = "effect", direction: str = "GREATER") -> DataFrame:
    """Share of finite effects with the expected sign."""
    value = F.col(effect)
    good = value > 0 if direction == "GREATER" else value < 0
    return effects.where(value.isNotNull()).groupBy(*by).agg(
        F.avg(good.cast("double")).alias("favourable"), F.count(F.lit(1)).alias("periods"))


def concentration(effects: DataFrame, by: Sequence[str], is_year: Column, effect: str = "effect") -> DataFrame:
    """Largest yearly share of the absolute effect, and the population spread over all periods."""
    size = F.when(is_year, F.abs(F.col(effect)))
    return effects.where(F.col(effect).isNotNull()).groupBy(*by).agg(
        F.coalesce(ratio(F.max(size), F.sum(size)), F.lit(1.0)).alias("year_concentration"),
        F.stddev_pop(effect).alias("dispersion"))


def period_means(rows: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Plain means by year and by half-year in one grouping-sets pass."""
    year, half = F.year(time), F.when(F.month(time) <= 6, F.lit("H1")).otherwise(F.lit("H2"))
    base = rows.select(*by, year.alias("year"), half.alias("half"), F.col(value).alias("_v"))
    keys = [F.col(b) for b in by]
    return base.groupingSets([[*keys, F.col("year")], [*keys, F.col("year"), F.col("half")]], *keys, F.col("year"), F.col("half")).agg(
        F.avg("_v").alias("mean"), F.count("_v").alias("rows"))


def stress_multipliers(rows: DataFrame, gross: str, net: str, multipliers: Sequence[float]) -> DataFrame:
    """Rows repeated per cost multiplier with the stressed return gross - m * (gross - net)."""
    return rows.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))).withColumn(
        "stressed", F.col(gross) - F.col("multiplier") * (F.col(gross) - F.col(net)))


def lag_within(df: DataFrame, keys: Sequence[str], order: str, value: str, steps: Sequence[int], prefix: str = "lagged") -> DataFrame:
    """Value of the same slot `steps` sessions earlier. Keys must name a slot of the day, so a group has one row per day."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{prefix}_{s}": F.lag(value, s).over(w) for s in steps})


def detrend(df: DataFrame, groups: Sequence[Column], value: str, name: str) -> DataFrame:
    """Value minus its group mean: group means are few, so they are aggregated and joined back as a broadcastable table."""
    keyed = df.withColumns({f"_k{i}": g for i, g in enumerate(groups)})
    keys = [f"_k{i}" for i in range(len(groups))]
    means = keyed.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return keyed.join(means, keys, "left").withColumn(name, F.col(value) - F.col("_mean")).drop("_mean", *keys)


def residuals(df: DataFrame, slow: str, targets: Mapping[str, str]) -> DataFrame:
    """Residuals of each target on one slow regressor with intercept, over complete rows."""
    from barwright.operators.quantiles import attach
    whole = df.where(F.col(slow).isNotNull())
    for column in targets:
        whole = whole.where(F.col(column).isNotNull())
    fits = []
    for column in targets:
        fits += [F.regr_slope(F.col(column), F.col(slow)).alias(f"_b_{column}"), F.regr_intercept(F.col(column), F.col(slow)).alias(f"_a_{column}")]
    fitted = attach(whole, whole.agg(*fits))
    out = {name: F.col(column) - (F.col(f"_a_{column}") + F.col(f"_b_{column}") * F.col(slow)) for column, name in targets.items()}
    return fitted.withColumns(out)


def skeptic(effects: DataFrame, by: Sequence[str], effect: str = "effect", direction: str = "GREATER") -> DataFrame:
    """Winsorised mean, drop-best, drop-worst and outlier share on a session effect table (one row per session)."""
    keys = list(by)
    order = Window.partitionBy(*keys).orderBy(effect, "session_id")
    size = Window.partitionBy(*keys).orderBy(F.abs(F.col(effect)).desc(), "session_id")
    limits = effects.groupBy(*keys).agg(F.percentile(effect, F.array(F.lit(0.05), F.lit(0.95))).alias("_q"), F.count(F.lit(1)).alias("_n"))
    ranked = (effects.join(limits, keys).withColumn("_cut", F.greatest(F.lit(1), F.floor(F.col("_n") * 0.05)))
                     .withColumn("_up", F.row_number().over(order)).withColumn("_big", F.row_number().over(size)))
    value = F.col(effect)
    facts = ranked.groupBy(*keys).agg(
        F.avg(F.least(F.greatest(value, F.col("_q")[0]), F.col("_q")[1])).alias("winsorised"),
        F.avg(F.when(F.col("_up") <= F.col("_n") - F.col("_cut"), value)).alias("drop_best"),
        F.avg(F.when(F.col("_up") > F.col("_cut"), value)).alias("drop_worst"),
        F.coalesce(ratio(F.sum(F.when(F.col("_big") <= F.col("_cut"), F.abs(value))), F.sum(F.abs(value))), F.lit(0.0)).alias("outlier_share"))

    def good(name: str) -> Column:
        x = F.coalesce(F.col(name), F.lit(0.0))
        return x > 0 if direction == "GREATER" else x < 0
    survived = [good("winsorised"), good("drop_best"), good("drop_worst"), F.col("outlier_share") <= 0.5]
    return facts.withColumn("effect_attacks_survived", sum((s.cast("int") for s in survived), F.lit(0)))


def skeptic_survival(facts: DataFrame, temporal_share: Column, cost_2x: Column, blocking: Column) -> DataFrame:
    """The whole battery: the effect attacks of `skeptic`, concentration in time (at least 0.6 of the periods agree), double cost where
    cost applies (NULL: it does not), blocking data errors, and gaps, which are survived because outcomes across gaps are left out."""
    applies = cost_2x.isNotNull()
    more = [F.coalesce(temporal_share >= 0.6, F.lit(False)), F.coalesce(cost_2x, F.lit(False)), ~F.coalesce(blocking, F.lit(True)), F.lit(True)]
    survived = F.col("effect_attacks_survived") + sum((m.cast("int") for m in more), F.lit(0))
    attempted = F.lit(4) + 3 + applies.cast("int")
    return facts.withColumns({"attempted": attempted, "survived": survived, "survival": survived / attempted})


def negative_control_limit(effect: Column) -> Column:
    return 0.5 * F.greatest(F.abs(effect), F.lit(1e-12))


def negative_control_passed(effect: Column, controls: Sequence[Column]) -> Column:
    """Every control effect stays within half of the absolute effect."""
    limit = negative_control_limit(effect)
    out = F.lit(True)
    for control in controls:
        out = out & F.coalesce(F.abs(control) <= limit, F.lit(False))
    return out


# Weights of the evidence score: fixed values.
SCORE_WEIGHTS = {"effect_size": 0.10, "bootstrap_stability": 0.15, "temporal_stability": 0.15, "cost_robustness": 0.10,
                 "multiple_testing": 0.15, "sample_size": 0.05, "data_quality": 0.10, "parameter_stability": 0.10, "negative_controls": 0.10}


def evidence_score(df: DataFrame, minimum_effect: float | Column) -> DataFrame:
    """Weighted score of nine components and the rejection reasons of a result table; a positive effect is a favourable one."""
    minimum_effect = minimum_effect if isinstance(minimum_effect, Column) else F.lit(float(minimum_effect))
    size = F.least(F.lit(1.0), F.abs("effect") / F.when(minimum_effect > 0, minimum_effect).otherwise(F.greatest(F.abs("effect"), F.lit(1e-12))))
    parts = {"effect_size": size, "bootstrap_stability": F.col("bootstrap_favourable"), "temporal_stability": F.col("temporal_favourable"),
             "cost_robustness": F.col("cost_favourable"), "multiple_testing": 1 - F.col("adjusted_p"),
             "sample_size": F.least(F.lit(1.0), F.col("sessions") / 200), "data_quality": F.col("quality_ok").cast("double"),
             "parameter_stability": F.col("parameter_favourable"), "negative_controls": F.col("controls_passed").cast("double")}
    score = sum((part * SCORE_WEIGHTS[name] for name, part in parts.items()), F.lit(0.0))
    checks = [("effect_direction_failed", F.col("effect") > 0), ("economic_materiality_failed", F.abs("effect") >= minimum_effect),
              ("multiple_testing_failed", F.col("adjusted_p") <= 0.05), ("temporal_stability_failed", F.col("temporal_favourable") >= 0.6),
              ("parameter_stability_failed", F.col("parameter_favourable") >= 0.6), ("negative_control_failed", F.col("controls_passed")),
              ("minimum_support_failed", F.col("support_passed"))]
    survives = ((F.col("bootstrap_favourable") >= 0.9) & (F.col("skeptic_survival") >= 0.65) & (F.col("sessions") >= 50))
    return (df.withColumn("score", score).withColumn("rejection_reasons", failed_names(checks))
              .withColumn("verdict", F.when((F.size("rejection_reasons") == 0) & survives, F.lit("DEV_SURVIVOR")).otherwise(F.lit("REJECTED"))))


# Gates of the confirmation verdict: fixed values.
CONFIRMATION_GATES = {"ci95_low": 0.0, "holm_p": 0.05, "bootstrap": 0.90, "sign": 0.90, "rows": 5000, "sessions": 200, "years": 3,
                      "temporal": 0.6, "year_share": 0.6, "skeptic": 0.75}


def confirmation_verdict(df: DataFrame, gates: Mapping[str, float] = CONFIRMATION_GATES) -> DataFrame:
    """Ten replication checks and the three-way verdict of a frozen hypothesis."""
    checks = [("same_direction", F.col("effect") > 0), ("ci95_directional", F.col("ci95_low") > gates["ci95_low"]),
              ("holm", F.col("holm_p") <= gates["holm_p"]), ("bootstrap_favourable", F.col("favourable") >= gates["bootstrap"]),
              ("sign_stability", F.col("sign_stability") >= gates["sign"]),
              ("support", (F.col("condition_rows") >= gates["rows"]) & (F.col("condition_sessions") >= gates["sessions"]) & (F.col("condition_years") >= gates["years"])),
              ("temporal", F.col("temporal_favourable") >= gates["temporal"]), ("not_year_concentrated", F.col("year_concentration") <= gates["year_share"]),
              ("skeptic", F.col("skeptic_survival") >= gates["skeptic"]), ("slow_structure", F.col("slow_passed"))]
    out = df.withColumn("failed_checks", failed_names(checks))
    return out.withColumn("verdict", F.when(F.size("failed_checks") > 0, F.lit("VALIDATION_FAILED"))
                          .when(F.col("net_return") > 0, F.lit("VALIDATED_ECONOMIC_CANDIDATE")).otherwise(F.lit("VALIDATED_PREDICTIVE_RELATIONSHIP_NO_TRADE")))


def attacks(entries: DataFrame, by: Sequence[str], net: str, trim: str | None = None, session: str = "session_id", top: int = 10) -> DataFrame:
    """Trim, winsorise and concentration attacks on the mean of `net` per group.

    Quantiles are exact and distributed; the best sessions are removed through per-session sums, so no row
    is joined back. The group list is a fixed set of specifications, which bounds the broadcast table.
    """
    keys, trim = list(by), trim or net
    cuts = exact_quantiles(entries, net, [0.01, 0.99], by=keys, names=["_q01", "_q99"], few_groups=True)
    upper = exact_quantiles(entries, trim, [0.95], by=keys, names=["_q95"], few_groups=True)
    limited = entries.join(F.broadcast(cuts), keys, "left").join(F.broadcast(upper), keys, "left")
    value = F.col(net)
    per = limited.groupBy(*keys, session).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_rows"),
        F.sum(F.when(F.col(trim) < F.col("_q95"), value)).alias("_ts"), F.count(F.when(F.col(trim) < F.col("_q95"), value)).alias("_tn"),
        F.sum(F.least(F.greatest(value, F.col("_q01")), F.col("_q99"))).alias("_ws"))
    return attacked_sessions(per, keys, session, top)


def attacked_sessions(per: DataFrame, keys: Sequence[str], session: str = "session_id", top: int = 10) -> DataFrame:
    """`attacks` from one row per group and session: sum, count and mean of the value (_s, _n, _m), all rows (_rows), sum and count below the
    trim (_ts, _tn), and the winsorised sum (_ws)."""
    # Means that differ in the last digits only are ties, settled by the session.
    level = F.round("_m", 12)
    best = Window.partitionBy(*keys).orderBy(level.desc_nulls_last(), session)
    largest = Window.partitionBy(*keys).orderBy(F.abs(level).desc_nulls_last(), session)
    ranked = per.withColumn("_best", F.row_number().over(best)).withColumn("_large", F.row_number().over(largest))
    rest = F.col("_best") > top
    return ranked.groupBy(*keys).agg(
        ratio(F.sum("_s"), F.sum("_n")).alias("mean"), ratio(F.sum("_ts"), F.sum("_tn")).alias("remove_best_5pct"),
        ratio(F.sum(F.when(rest, F.col("_s"))), F.sum(F.when(rest, F.col("_n")))).alias("remove_best_sessions"),
        ratio(F.sum("_ws"), F.sum("_n")).alias("winsorised"),
        ratio(F.sum(F.when(F.col("_large") <= top, F.abs("_m"))), F.greatest(F.sum(F.abs("_m")), F.lit(1e-15))).alias("temporal_concentration"),
        ratio(F.sum(F.when(~rest, F.col("_rows"))), F.sum("_rows")).alias("sample_concentration"))


def economic_skeptic(entries: DataFrame, by: Sequence[str], strong: Column, gross: str = "gross", cost: str = "cost", net: str = "net",
                     regime: str = "state_regime") -> DataFrame:
    """The economic attack battery with its failure list per group."""
    keys = list(by)
    base = attacks(entries, keys, net)
    g, c = F.col(gross), F.col(cost)
    stress = entries.groupBy(*keys).agg(
        F.avg(g - 1.5 * c).alias("cost_1_5x"), F.avg(g - 2.0 * c).alias("cost_2x"), F.avg(g - 1.1 * c).alias("spread_10pct"),
        F.avg(F.when(strong, F.col(net))).alias("stronger_signal"), (count_where(g.isNull()) == 0).alias("gap_free"))
    per_regime = entries.groupBy(*keys, regime).agg(F.avg(net).alias("_m"))
    regimes = per_regime.groupBy(*keys).agg(F.count(F.lit(1)).alias("regimes"), count_where(F.col("_m") > 0).alias("positive_regimes"))
    return economic_verdict(base.join(stress, keys).join(regimes, keys))


def economic_verdict(out: DataFrame) -> DataFrame:
    """The failure list of a table of attacked means, concentrations and regimes."""
    checks = [(n, F.col(n) > 0) for n in ("remove_best_5pct", "remove_best_sessions", "winsorised", "cost_1_5x", "spread_10pct", "mean", "stronger_signal")]
    checks += [("temporal_concentration", F.coalesce(F.col("temporal_concentration") <= 0.6, F.lit(True))), ("gap_sensitivity", F.col("gap_free")),
               ("regime_dependence", (F.col("regimes") <= 1) | (F.col("positive_regimes") >= 2))]
    out = out.withColumn("failures", failed_names(checks))
    return out.withColumn("passed", F.size("failures") == 0)
