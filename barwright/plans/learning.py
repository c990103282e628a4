"""Learning queries: decision datasets from experiences, learners on a daily dataset of line items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from barwright.functions.hashing import uniform
from barwright.functions.numeric import count_where, rounded
from barwright.operators import boosting, learning as L, resampling as R, walkforward as W
from barwright.operators.quantiles import attach
from barwright.plans.bindings import Tables, rounded_all
from barwright.plans.evidence import u_sql
from barwright.plans.features import ESQL, experiences
from barwright.plans.oracle import r
from barwright.plans.registry import query
from barwright.plans.stability import reasons_sql
from barwright.session import ensure_checkpoint_dir, materialize

MINUTE, H, ATR = 30, 5, 0.2
FEATURES = ["state_vol_short", "state_vol_long", "state_atr", "state_bar_range", "state_return_1", "state_return_5", "state_dist_high", "state_dist_low", "state_spread_points"]
DEC = ESQL + f""", dec AS (SELECT session_id, max(CASE action WHEN 'WAIT' THEN decision_ts END) AS decision_ts, max(CASE action WHEN 'WAIT' THEN close END) AS close, max(CASE action WHEN 'WAIT' THEN state_regime END) AS state_regime,
 max(CASE action WHEN 'LONG' THEN cost_method_{H} END) AS cost_method, {', '.join(f"max(CASE action WHEN 'WAIT' THEN {f} END) AS {f}" for f in FEATURES)}, {', '.join(f"max(CASE action WHEN '{a}' THEN {f}_{H} END) AS {a.lower()}_{f}" for a in ('LONG', 'SHORT') for f in ('gross', 'net', 'cost', 'mfe', 'mae'))}
 FROM exps WHERE minute = {MINUTE} GROUP BY session_id),
 tgt AS (SELECT *, {ATR} * state_atr / nullif(close, 0) AS barrier FROM dec), lab AS (SELECT *, CASE WHEN long_net IS NULL OR short_net IS NULL OR barrier IS NULL THEN NULL WHEN long_net > barrier THEN 2 WHEN short_net > barrier THEN 0 ELSE 1 END AS target FROM tgt)"""


def decisions(t: Tables) -> DataFrame:
    return L.with_target(L.decision_rows(experiences(t), MINUTE, H, FEATURES), ATR)


@query("ml01_decision_dataset", DEC + f" SELECT session_id, decision_ts, {', '.join(f'{r(c)} AS {c}' for c in ['close', 'state_atr', 'long_gross', 'long_net', 'short_gross', 'short_net'])} FROM dec")
def decision_dataset(t: Tables) -> DataFrame:
    d = decisions(t)
    return d.select("session_id", "decision_ts", *[rounded(c).alias(c) for c in ("close", "state_atr", "long_gross", "long_net", "short_gross", "short_net")])


@query("ml02_three_class_target", DEC + f" SELECT session_id, {r('barrier')} AS barrier, target FROM lab")
def target(t: Tables) -> DataFrame:
    return decisions(t).select("session_id", rounded("barrier").alias("barrier"), "target")


@query("ml03_feature_contract", DEC + f" SELECT session_id, {', '.join(f'{r(f)} AS {f}' for f in FEATURES)}, {', '.join(f"(state_regime = '{g}')::INT::DOUBLE AS regime_{g}" for g in L.REGIMES)} FROM lab WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}")
def feature_contract(t: Tables) -> DataFrame:
    d = L.complete_cases(L.with_regime_flags(decisions(t)), FEATURES)
    return d.select("session_id", *[rounded(f).alias(f) for f in FEATURES], *[f"regime_{g}" for g in L.REGIMES])


@query("ml04_auxiliary_targets", DEC + f" SELECT session_id, {r('long_mfe')} AS long_mfe, {r('long_mae')} AS long_mae, {r('short_mfe')} AS short_mfe, {r('short_mae')} AS short_mae, (long_mfe > barrier + long_cost)::INT AS long_reaches, (short_mfe > barrier + short_cost)::INT AS short_reaches FROM lab")
def auxiliary(t: Tables) -> DataFrame:
    d = L.with_auxiliary(decisions(t))
    return d.select("session_id", *[rounded(c).alias(c) for c in ("long_mfe", "long_mae", "short_mfe", "short_mae")], "long_reaches", "short_reaches")


USABLE = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES) + " AND target IS NOT NULL"


@query("ml05_dataset_manifest", DEC + f" SELECT count(*) AS sessions, count(*) FILTER ({USABLE}) AS usable, count(*) FILTER (NOT ({USABLE})) AS excluded, count(*) FILTER ({USABLE} AND target = 0) AS class_down, count(*) FILTER ({USABLE} AND target = 1) AS class_no_trade, count(*) FILTER ({USABLE} AND target = 2) AS class_up, string_agg(DISTINCT cost_method, ',' ORDER BY cost_method) AS cost_methods FROM lab")
def manifest(t: Tables) -> DataFrame:
    return L.dataset_manifest(decisions(t), FEATURES)


IMPUTED = ["state_atr", "state_dist_high", "state_return_5"]


@query("ml06_median_imputation", ESQL + ", w AS (SELECT * FROM states), m AS (SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in IMPUTED) + " FROM w WHERE ts < TIMESTAMP '2024-01-16') SELECT ts, " + ", ".join(f"{r(f'coalesce({f}, m_{f}, 0)')} AS {f}" for f in IMPUTED) + " FROM w, m")
def imputation(t: Tables) -> DataFrame:
    s = experiences(t).where(F.col("action") == "WAIT")
    filled = L.impute_median(s.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp")), s, IMPUTED)
    return filled.select("ts", *[rounded(f).alias(f) for f in IMPUTED])


# ---- deterministic predictions: hashed class scores on the sessions of the ledger ---------------------

PRED = "WITH d AS (SELECT l_shipdate AS ts, l_shipdate::DATE::VARCHAR AS id, avg(l_discount) - 0.03 AS long_gross, avg(l_tax) / 4 AS long_cost, 0.07 - avg(l_discount) AS short_gross, avg(l_tax) / 4 AS short_cost, CASE WHEN avg(l_discount) > 0.052 THEN 2 WHEN avg(l_discount) < 0.048 THEN 0 ELSE 1 END AS label FROM lineitem GROUP BY l_shipdate)," + f"""
 u AS (SELECT *, {u_sql('id', "'a'")} AS a, {u_sql('id', "'b'")} AS b, {u_sql('id', "'c'")} AS c FROM d), pr AS (SELECT *, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM u),
 sc AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred, year(ts)::INT AS year FROM pr)"""


def daily(t: Tables) -> DataFrame:
    d = t.read("lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(
        (F.avg("l_discount") - 0.03).alias("long_gross"), (F.avg("l_tax") / 4).alias("long_cost"), (0.07 - F.avg("l_discount")).alias("short_gross"), (F.avg("l_tax") / 4).alias("short_cost"),
        F.when(F.avg("l_discount") > 0.052, 2).when(F.avg("l_discount") < 0.048, 0).otherwise(1).alias("label"), F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"),
        F.avg("l_tax").alias("tax"), F.count(F.lit(1)).cast("double").alias("items"), F.avg("l_discount").alias("discount"))
    return d.withColumn("id", F.date_format("ts", "yyyy-MM-dd"))


def predictions(t: Tables) -> DataFrame:
    d = daily(t).withColumns({k: uniform(F.col("id"), F.lit(k)) for k in ("a", "b", "c")})
    total = F.col("a") + F.col("b") + F.col("c")
    return d.withColumn("p", F.array(*[F.col(k) / total for k in ("a", "b", "c")])).withColumn("spread", F.array(F.lit(0.1), F.lit(0.1), F.lit(0.1))).withColumn("year", F.year("ts"))


METRIC = ["balanced_accuracy", "log_loss", "brier", "ece"]
METRICS_SQL = f""", mt AS (SELECT year, count(*) AS "rows", list_avg(list_filter([avg(CASE WHEN label = 0 THEN (pred = 0)::INT END), avg(CASE WHEN label = 1 THEN (pred = 1)::INT END), avg(CASE WHEN label = 2 THEN (pred = 2)::INT END)], lambda x: x IS NOT NULL)) AS balanced_accuracy,
 avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS log_loss, avg((p0 - (label = 0)::INT) ** 2 + (p1 - (label = 1)::INT) ** 2 + (p2 - (label = 2)::INT) ** 2) AS brier FROM sc GROUP BY year),
 ec AS (SELECT year, sum(n * abs(h - c)) / sum(n) AS ece FROM (SELECT year, least(floor(conf * 10), 9) AS bin, count(*) AS n, avg((pred = label)::INT) AS h, avg(conf) AS c FROM sc GROUP BY ALL) GROUP BY year)"""


@query("ml11_metrics", PRED + METRICS_SQL + f" SELECT year, \"rows\", {', '.join(f'{r(c)} AS {c}' for c in METRIC)} FROM mt JOIN ec USING (year)")
def metrics(t: Tables) -> DataFrame:
    return rounded_all(L.classification_metrics(predictions(t), ["year"]), METRIC)


ECON_SQL = """, dc AS (SELECT *, pred <> 1 AND conf >= 0.45 AS trade, CASE WHEN pred <> 1 AND conf >= 0.45 THEN CASE WHEN pred = 2 THEN long_gross - {m} * long_cost ELSE short_gross - {m} * short_cost END ELSE 0.0 END AS net FROM sc)"""


@query("ml12_economic_decision", PRED + ECON_SQL.format(m=1) + f""" SELECT 'ALL' AS scope, count(*) FILTER (trade) AS trades, {r('avg(trade::INT)')} AS coverage, {r('coalesce(avg(CASE WHEN trade THEN net END), 0)')} AS mean_net, {r('sum(net)')} AS cumulative_net, {r('coalesce(avg(CASE WHEN trade THEN (net > 0)::INT END), 0)')} AS win_rate,
 {r('(SELECT avg((x > 0)::INT) FROM (SELECT year, sum(net) AS x FROM dc GROUP BY year))')} AS positive_years FROM dc""")
def economic(t: Tables) -> DataFrame:
    d = L.economic_decision(predictions(t).withColumn("scope", F.lit("ALL")), 0.45, 0.2)
    return rounded_all(L.economic_summary(d, ["scope"], "ts"), ["coverage", "mean_net", "cumulative_net", "win_rate", "positive_years"])


@query("ml13_climatology", PRED + f""", f AS (SELECT avg((label = 0)::INT) AS p0, avg((label = 1)::INT) AS p1, avg((label = 2)::INT) AS p2 FROM d WHERE ts < TIMESTAMP '1996-01-01') SELECT year(ts)::INT AS year, {r('avg(-ln(CASE label WHEN 0 THEN f.p0 WHEN 1 THEN f.p1 ELSE f.p2 END))')} AS log_loss, {r('max(f.p0)')} AS p_down, {r('max(f.p1)')} AS p_none, {r('max(f.p2)')} AS p_up FROM d, f WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY 1""")
def climatology(t: Tables) -> DataFrame:
    d = daily(t)
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    base = attach(d.where(F.col("ts") >= cut), L.class_frequencies(d.where(F.col("ts") < cut))).withColumn("year", F.year("ts"))
    m = L.classification_metrics(base, ["year"]).select("year", rounded("log_loss").alias("log_loss"))
    rates = base.groupBy("year").agg(*[rounded(F.max(F.col("p")[i])).alias(n) for i, n in enumerate(("p_down", "p_none", "p_up"))])
    return m.join(rates, "year")


@query("ml15_skeptic", PRED + ECON_SQL.format(m=2).replace("dc AS", "dc2 AS") + ECON_SQL.format(m=1) + f""", sh AS (SELECT pred, lag(label, 7) OVER (ORDER BY ts) AS label FROM sc), tr AS (SELECT net, row_number() OVER (ORDER BY net DESC, id) AS k, count(*) OVER () AS n FROM dc WHERE trade),
 pl AS (SELECT net, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM dc WHERE trade), dr AS (SELECT r, floor({u_sql("'K'", 'r', 'pos')} * n)::BIGINT AS draw FROM pl, (SELECT unnest(range(2000)) AS r)),
 bs AS (SELECT r, avg(pl.net) AS m FROM dr JOIN pl ON pl.pos = dr.draw GROUP BY r)
 SELECT (SELECT {r('list_avg(list_filter([avg(CASE WHEN label = 0 THEN (pred = 0)::INT END), avg(CASE WHEN label = 1 THEN (pred = 1)::INT END), avg(CASE WHEN label = 2 THEN (pred = 2)::INT END)], lambda x: x IS NOT NULL))')} FROM sh WHERE label IS NOT NULL) AS shifted_accuracy,
 (SELECT {r('avg(net)')} FROM dc2 WHERE trade) AS cost_2x_mean, (SELECT {r('avg(CASE WHEN k > greatest(1, ceil(n * 0.05)) THEN net END)')} FROM tr) AS after_best_removed, (SELECT {r('quantile_cont(m, 0.025)')} FROM bs) AS ci_low, (SELECT {r('quantile_cont(m, 0.975)')} FROM bs) AS ci_high""")
def ml_skeptic(t: Tables) -> DataFrame:
    p = materialize(predictions(t))
    by = ["scope"]
    one = L.economic_decision(p.withColumn("scope", F.lit("ALL")), 0.45, 0.2)
    shifted = p.withColumn("label", F.lag("label", 7).over(Window.orderBy("ts"))).where("label IS NOT NULL").withColumn("scope", F.lit("ALL"))
    accuracy = L.classification_metrics(shifted, by).select("scope", rounded("balanced_accuracy").alias("shifted_accuracy"))
    double = L.economic_decision(p.withColumn("scope", F.lit("ALL")), 0.45, 0.2, 2.0).where("trade").groupBy(*by).agg(rounded(F.avg("net")).alias("cost_2x_mean"))
    traded = one.where("trade").select("scope", "id", F.col("net").alias("effect"))
    cut = traded.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("effect"), "id"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    best = cut.groupBy(*by).agg(rounded(F.avg(F.when(F.col("_k") > F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.05)), F.col("effect")))).alias("after_best_removed"))
    boot = R.session_bootstrap(R.positions(traded, by, ["id"]), by, 2000, F.lit("K")).groupBy(*by).agg(
        rounded(F.percentile("mean", F.lit(0.025))).alias("ci_low"), rounded(F.percentile("mean", F.lit(0.975))).alias("ci_high"))
    return accuracy.join(double, by).join(best, by).join(boot, by).drop("scope")


FACTS_SQL = METRICS_SQL + ECON_SQL.format(m=1) + ECON_SQL.format(m=2).replace("dc AS", "dc2 AS") + f""", sh AS (SELECT year, pred, lag(label, 7) OVER (PARTITION BY year ORDER BY ts) AS label FROM sc),
 sa AS (SELECT year, list_avg(list_filter([avg(CASE WHEN label = 0 THEN (pred = 0)::INT END), avg(CASE WHEN label = 1 THEN (pred = 1)::INT END), avg(CASE WHEN label = 2 THEN (pred = 2)::INT END)], lambda x: x IS NOT NULL)) AS shifted_accuracy FROM sh WHERE label IS NOT NULL GROUP BY year),
 tr AS (SELECT year, net, row_number() OVER (PARTITION BY year ORDER BY net DESC, id) AS k, count(*) OVER (PARTITION BY year) AS n FROM dc WHERE trade), ab AS (SELECT year, avg(CASE WHEN k > greatest(1, ceil(n * 0.05)) THEN net END) AS after_best_removed FROM tr GROUP BY year),
 c2 AS (SELECT year, avg(net) AS cost_2x_mean FROM dc2 WHERE trade GROUP BY year), mo AS (SELECT year, avg((x > 0)::INT) AS positive_share FROM (SELECT year, month(ts) AS m, sum(net) AS x FROM dc GROUP BY ALL) GROUP BY year),
 y AS (SELECT year, coalesce(avg(CASE WHEN trade THEN net END), 0) AS mean_net, count(*) FILTER (trade) AS trades FROM dc GROUP BY year),
 pl AS (SELECT year, net, row_number() OVER (PARTITION BY year ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY year) AS n FROM dc WHERE trade), reps AS (SELECT unnest(range(1000)) AS r),
 bs AS (SELECT year, r, avg(pl.net) AS m FROM (SELECT year, r, floor({u_sql("'K'", 'r', 'pos')} * n)::BIGINT AS draw FROM pl, reps) d JOIN pl USING (year) WHERE pl.pos = d.draw GROUP BY ALL), cl AS (SELECT year, quantile_cont(m, 0.025) AS ci_low FROM bs GROUP BY year),
 pa AS (SELECT year, net, row_number() OVER (PARTITION BY year ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY year) AS n FROM dc),
 bb AS (SELECT year, r, avg(pa.net) AS m FROM (SELECT year, r, floor({u_sql("'L'", 'r', '(pos // 20)')} * (n - 20 + 1))::BIGINT + pos % 20 AS draw FROM pa, reps WHERE n >= 100) d JOIN pa USING (year) WHERE pa.pos = d.draw GROUP BY ALL), bl AS (SELECT year, quantile_cont(m, 0.025) AS block_low FROM bb GROUP BY year),
 cf AS (SELECT avg((label = 0)::INT) AS q0, avg((label = 1)::INT) AS q1, avg((label = 2)::INT) AS q2 FROM d WHERE ts < TIMESTAMP '1996-01-01'), ba AS (SELECT year(ts)::INT AS year, avg(-ln(CASE label WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END)) AS baseline_log_loss FROM d, cf GROUP BY 1),
 rc AS (SELECT year(l_shipdate)::INT AS year, bool_and(l_linestatus = 'F') AS real_costs FROM lineitem GROUP BY 1),
 fa AS (SELECT * FROM mt JOIN ec USING (year) JOIN y USING (year) JOIN sa USING (year) JOIN ba USING (year) JOIN rc USING (year) JOIN mo USING (year) LEFT JOIN ab USING (year) LEFT JOIN c2 USING (year) LEFT JOIN cl USING (year) LEFT JOIN bl USING (year)),
 te AS (SELECT *, {reasons_sql([("bootstrap_ci_lower_positive", "ci_low > 0"), ("positive_in_at_least_75pct_periods", "positive_share >= 0.75"), ("survives_cost_2x", "cost_2x_mean > 0"), ("survives_remove_best_5pct", "after_best_removed > 0"),
                                ("beats_label_shift", "balanced_accuracy > shifted_accuracy + 0.02"), ("calibration_ece", "ece <= 0.10"), ("mean_spread", "true"), ("block_bootstrap_positive", "block_low > 0")])} AS failed FROM fa)"""
FACTS = ["balanced_accuracy", "log_loss", "baseline_log_loss", "ece", "mean_net", "ci_low", "block_low", "positive_share", "cost_2x_mean", "after_best_removed", "shifted_accuracy"]


def judged_years(t: Tables, p: DataFrame) -> DataFrame:
    """Everything the verdict of a year reads, computed from its predictions: metrics, economics, the skeptic's tests, climatology, kinds of cost."""
    by = ["year"]
    p = materialize(p)
    one, two = (materialize(L.economic_decision(p, 0.45, 0.2, m)) for m in (1.0, 2.0))
    shifted = p.withColumn("label", F.lag("label", 7).over(Window.partitionBy("year").orderBy("ts"))).where("label IS NOT NULL")
    accuracy = L.classification_metrics(shifted, by).select("year", F.col("balanced_accuracy").alias("shifted_accuracy"))
    double = two.where("trade").groupBy(*by).agg(F.avg("net").alias("cost_2x_mean"))
    traded = one.where("trade").select("year", "id", F.col("net").alias("effect"))
    ranked = traded.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("effect"), "id"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    best = ranked.groupBy(*by).agg(F.avg(F.when(F.col("_k") > F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.05)), F.col("effect"))).alias("after_best_removed"))
    low = R.session_bootstrap(R.positions(traded, by, ["id"]), by, 1000, F.lit("K")).groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"))
    days = R.positions(one.select("year", "id", F.col("net").alias("effect")), by, ["id"]).where("n >= 100")
    block = R.block_bootstrap(days, by, 1000, F.lit("L"), F.lit(20)).groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("block_low"))
    months = one.groupBy(*by, F.month("ts")).agg(F.sum("net").alias("_x")).groupBy(*by).agg(F.avg((F.col("_x") > 0).cast("double")).alias("positive_share"))
    spread = one.groupBy(*by).agg(F.avg(F.aggregate("spread", F.lit(0.0), lambda a, x: a + x) / F.size("spread")).alias("mean_spread"))
    known = daily(t)
    base = attach(known, L.class_frequencies(known.where(F.col("ts") < F.lit("1996-01-01").cast("timestamp_ntz")))).withColumn("year", F.year("ts"))
    baseline = L.classification_metrics(base, by).select("year", F.col("log_loss").alias("baseline_log_loss"))
    costs = t.read("lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("real_costs"))
    out = L.classification_metrics(p, by).join(L.economic_summary(one, by, "ts").select("year", "mean_net", "trades"), by)
    for part in (accuracy, baseline, costs, months, spread):
        out = out.join(part, by)
    for part in (best, double, low, block):
        out = out.join(part, by, "left")
    return L.promotion_verdict(L.skeptic_tests(out, 0.2), {"balanced_accuracy": 0.34, "trades": 10})


@query("ml19_promotion_verdict", PRED + FACTS_SQL + f""" SELECT year, trades, real_costs, {', '.join(f'{r(c)} AS {c}' for c in FACTS)}, array_to_string(failed, ',') AS failed_tests,
 CASE WHEN NOT (balanced_accuracy >= 0.34 AND log_loss < baseline_log_loss AND mean_net > 0 AND trades >= 10) THEN 'REJECTED' WHEN len(failed) > 0 OR NOT real_costs THEN 'RESEARCH_ONLY' ELSE 'VALIDATION_READY' END AS verdict FROM te""")
def promotion(t: Tables) -> DataFrame:
    """The verdict of every year on hashed scores; all gates are computed."""
    return judged_years(t, predictions(t)).select("year", "trades", "real_costs", *[rounded(c).alias(c) for c in FACTS], F.concat_ws(",", "failed_tests").alias("failed_tests"), "verdict")


@query("ml19_trained_verdict")
def trained_promotion(t: Tables) -> DataFrame:
    """The same verdict on the out-of-fold ensemble of the trained models."""
    e = L.ensemble(oof(t), ["id", "label", "fold", "ts", *MONEY]).withColumn("year", F.col("fold"))
    return judged_years(t, e).select("year", "trades", "real_costs", *FACTS, F.concat_ws(",", "failed_tests").alias("failed_tests"), "verdict")


# ---- learners (trained: rows only, beside what is determined) ------------------------------------------

DAILY = ["quantity", "price", "tax", "items", "discount"]
FOLDS, SEED = (1996, 1997, 1998, 1999, 2000, 2001), 17
MONEY = ["long_gross", "long_cost", "short_gross", "short_cost"]


def yesterday(t: Tables) -> DataFrame:
    """Daily rows with yesterday's features; the first day has none."""
    return L.lagged_features(daily(t), DAILY, "ts", 1).withColumn("ts", F.col("ts").cast("timestamp"))


def tagged(t: Tables) -> DataFrame:
    """Yesterday's features with fold roles and the fit, stop and calibrate parts of training."""
    def build() -> DataFrame:
        rows = W.tag_folds(yesterday(t), "ts", FOLDS[0], 30, 30)
        train = W.temporal_parts(rows.where(F.col("role") == "TRAIN"), "ts", ["fold"])
        return train.unionByName(rows.where(F.col("role") == "TEST"), allowMissingColumns=True)
    return t.stored("ml_tagged", build)


_BOOSTERS: dict[tuple, object] = {}


def scored(t: Tables) -> DataFrame:
    """Raw scores of all learners and folds on calibration and test rows; the trees are remembered by the session."""
    def build() -> DataFrame:
        table, booster = L.boosted_scores(L.coded_parts(tagged(t), FOLDS, seed=SEED), DAILY, len(FOLDS), keep=["ts", *MONEY])
        _BOOSTERS[(t.spark.sparkContext.applicationId, t.dir)] = booster
        return table
    return t.stored("ml_scored", build)


def oof(t: Tables) -> DataFrame:
    return t.stored("ml_oof", lambda: L.calibrated_tests(scored(t), len(FOLDS))[0].select("id", "label", "fold", "ts", *MONEY, "learner", "p"))


def booster(t: Tables):
    scored(t)
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _BOOSTERS:
        # Another process of this application published the scores: the same rows give the same trees.
        _BOOSTERS[key] = L.boosted_scores(L.coded_parts(tagged(t), FOLDS, seed=SEED), DAILY, len(FOLDS), keep=["ts", *MONEY])[1]
    return _BOOSTERS[key]


@query("ml07_classifiers")
def classifiers(t: Tables) -> DataFrame:
    """Raw class scores of the three learners on all test years, before calibration."""
    test = scored(t).where(F.col("part_code") == L.PART_CODES["TEST"]).withColumn("p", F.col("score"))
    return L.classification_metrics(test, ["learner"])


@query("ml07_rounds")
def rounds(t: Tables) -> DataFrame:
    """Rounds that count per fold and learner, and the held-out loss at the start, after 10 and 60 rounds, at the best and at the last."""
    b = booster(t)

    def at(n: int, g: int, l: int) -> float | None:
        return float(b.loss[n, g, l]) if n < len(b.loss) else None
    rows = [(fold, name, int(b.used[g, l]), len(b.loss) - 1, at(0, g, l), at(10, g, l), at(60, g, l), at(int(b.used[g, l]), g, l), at(len(b.loss) - 1, g, l)) for g, fold in enumerate(FOLDS) for l, name in enumerate(boosting.LEARNERS)]
    return t.spark.createDataFrame(rows, "fold int, learner string, rounds_used int, rounds_grown int, loss_0 double, loss_10 double, loss_60 double, loss_best double, loss_last double")


TARGETS = ("long_gross", "short_gross", "long_cost", "short_cost")


@query("ml08_regressors")
def regressors(t: Tables) -> DataFrame:
    """Mean absolute error of the regressors and their mean, for four targets on each test year."""
    rows = materialize(L.imputed(L.coded_parts(tagged(t), FOLDS, seed=SEED), DAILY)[0])
    trees = boosting.train(rows, DAILY, TARGETS, len(FOLDS), "targets", key="draw_key")
    found = boosting.predict(rows.where(F.col("part_code") == L.PART_CODES["TEST"]), trees, DAILY, ["id", "fold", *TARGETS])
    listed = F.array(*[F.struct(F.lit(name).alias("target"), F.col(name).cast("double").alias("label"), F.col("score")[i].alias("prediction")) for i, name in enumerate(TARGETS)])
    out = materialize(found.select("id", "fold", "learner", F.inline(listed)))
    mean = out.groupBy("id", "fold", "target", "label").agg(F.avg("prediction").alias("prediction")).withColumn("learner", F.lit("ensemble"))
    return out.unionByName(mean).groupBy("fold", "target", "learner").agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae"), F.count(F.lit(1)).alias("rows"))


@query("ml09_calibration")
def calibration(t: Tables) -> DataFrame:
    """Calibrated probabilities sum to one per row; metrics per learner."""
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    sums = oof(t).groupBy("learner").agg(count_where(F.abs(total - 1) > 1e-6).alias("bad_sums"))
    return L.classification_metrics(oof(t), ["learner"]).join(sums, "learner")


# What training cannot change: which rows are predicted, how often, and from which history.
DAYS_SQL = "SELECT l_shipdate::DATE AS day FROM lineitem GROUP BY 1"
LEARNER_SQL = ", ".join(f"('{name}')" for name in boosting.LEARNERS)


@query("ml09_out_of_fold", f"""WITH d AS ({DAYS_SQL}) SELECT year(day)::INT AS fold, learner, count(*) AS "rows", count(DISTINCT day) AS days, 0::BIGINT AS bad_sums, 0::BIGINT AS outside_year, 0::BIGINT AS repeated, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day
 FROM d, (VALUES {LEARNER_SQL}) v(learner) WHERE year(day) IN {FOLDS} AND day::TIMESTAMP >= make_timestamp(year(day), 1, 1, 0, 0, 0) + INTERVAL 30 MINUTE GROUP BY ALL""")
def out_of_fold(t: Tables) -> DataFrame:
    """Every test day once per fold and learner, with probabilities that sum to one."""
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    per = oof(t).groupBy("fold", "learner", "id").agg(F.count(F.lit(1)).alias("n"), count_where((F.abs(total - 1) > 1e-6) | total.isNull()).alias("bad"))
    return per.groupBy("fold", "learner").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("days"), F.sum("bad").alias("bad_sums"), count_where(F.substring("id", 1, 4) != F.col("fold").cast("string")).alias("outside_year"),
                                              count_where(F.col("n") > 1).alias("repeated"), F.min("id").alias("first_day"), F.max("id").alias("last_day"))


@query("ml10_walk_forward_ensemble")
def walk_forward(t: Tables) -> DataFrame:
    """Out-of-fold ensemble per test year with disagreement and abstention economics."""
    e = L.ensemble(oof(t), ["id", "label", "fold", "ts", *MONEY])
    m = L.classification_metrics(e, ["fold"])
    econ = L.economic_summary(L.economic_decision(e, 0.45, 0.2), ["fold"], "ts")
    return m.join(econ, "fold")


@query("ml14_importance_stability")
def importance(t: Tables) -> DataFrame:
    return L.rank_stability(L.importances(booster(t), DAILY, FOLDS, t.spark))


@query("ml16_adversarial_controls")
def adversarial(t: Tables) -> DataFrame:
    """How the ensemble scores where it should find nothing (dealt labels, stale features) and under other seeds; all controls train together."""
    base = tagged(t)
    segments = base.withColumn("_seg", F.coalesce("part", F.lit("TEST")))
    shuffled = L.permuted_labels(segments.where(F.col("role") == "TRAIN"), "label", "ts", ["fold", "_seg"], 10, SEED)
    permuted = shuffled.unionByName(segments.where(F.col("role") == "TEST"), allowMissingColumns=True)
    lagged = L.lagged_features(base, DAILY, "ts", 7, ["fold"])
    runs = [("permuted_blocks", permuted, 0), ("lagged_7", lagged, 0), ("seed_plus_101", base, 101), ("seed_plus_202", base, 202)]
    rows = None
    for number, (_, table, shift) in enumerate(runs):
        own = L.coded_parts(table, FOLDS, number, SEED + shift).select("id", "label", "fold", "ts", "group", "part_code", "draw_key", *DAILY, *MONEY)
        rows = own if rows is None else rows.unionByName(own)
    groups = len(runs) * len(FOLDS)
    found, _ = L.calibrated_tests(materialize(L.boosted_scores(rows, DAILY, groups, keep=["ts", *MONEY])[0]), groups)
    control = F.array(*[F.lit(name) for name, *_ in runs])[F.floor(F.col("group") / len(FOLDS)).cast("int")]
    e = L.ensemble(found.withColumn("control", control), ["id", "label", "control", "ts", *MONEY])
    econ = L.economic_summary(L.economic_decision(e, 0.45, 0.2), ["control"], "ts").select("control", "trades", "cumulative_net")
    return L.classification_metrics(e, ["control"]).join(econ, "control")


@query("ml17_barrier_probabilities")
def barrier(t: Tables) -> DataFrame:
    """Binary probabilities that the long and that the short side clears its cost, per learner and ensemble; both tasks train together."""
    tasks = ("long", "short")
    rows = None
    for number, task in enumerate(tasks):
        own = L.coded_parts(tagged(t).withColumn("label", (F.col(f"{task}_gross") > F.col(f"{task}_cost") + 0.015).cast("int")), FOLDS, number, SEED)
        rows = own if rows is None else rows.unionByName(own)
    groups = len(tasks) * len(FOLDS)
    found, _ = L.calibrated_tests(materialize(L.boosted_scores(rows, DAILY, groups, classes=2)[0]), groups, 2)
    table = materialize(found.withColumn("task", F.array(*[F.lit(x) for x in tasks])[F.floor(F.col("group") / len(FOLDS)).cast("int")]).select("id", "label", "task", "learner", "p"))
    mean = L.ensemble(table, ["id", "label", "task"], 2).select("id", "label", "task", F.lit("ensemble").alias("learner"), "p")
    return L.binary_report(table.unionByName(mean).withColumn("probability", F.col("p")[1]), ["task", "learner"], "probability", "label")


@query("ml18_model_persistence", f"""WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM ({DAYS_SQL})) SELECT learner, count(*) AS "rows", 0::BIGINT AS different, (SELECT max(least(1, floor(n * 0.7))) FROM d)::BIGINT AS has_fit, 5::BIGINT AS tables FROM d, (VALUES {LEARNER_SQL}) v(learner) GROUP BY learner""")
def persistence(t: Tables) -> DataFrame:
    """The recipe fitted once more on all history, saved as tables, read back: the same scores for every day."""
    parts = W.temporal_parts(yesterday(t).withColumn("fold", F.lit(0)), "ts", ["fold"]).withColumn("role", F.lit("TRAIN"))
    coded = L.coded_parts(parts, (0,), seed=SEED)
    rows, medians = L.imputed(coded, DAILY)
    rows = materialize(rows)
    trees = boosting.train(rows, DAILY, ["label"], 1, "classes", 3, key="draw_key")
    model = F.array_position(F.array(*[F.lit(name) for name in boosting.LEARNERS]), F.col("learner")) - 1
    held = boosting.predict(rows.where(F.col("part_code") == L.PART_CODES["CALIBRATE"]), trees, DAILY, ["id", "label"]).withColumn("model", model.cast("int"))
    calibrators = boosting.calibrators(held, len(boosting.LEARNERS), 3)
    root = f"{ensure_checkpoint_dir(t.spark)}/models-{uuid.uuid4().hex}"
    sizes = {row["part_code"]: row["count"] for row in rows.groupBy("part_code").count().collect()}
    L.save_model(t.spark, root, trees, medians, calibrators, {"features": DAILY, "rows": {name: sizes.get(code, 0) for name, code in L.PART_CODES.items()}, "seed": SEED})
    again = L.load_model(t.spark, root)
    a = boosting.predict(rows, trees, DAILY, ["id"]).select("id", "learner", F.col("score").alias("_a"))
    b = boosting.predict(rows, again, DAILY, ["id"]).select("id", "learner", F.col("score").alias("_b"))
    tables = sum(bool(t.spark.read.parquet(f"{root}/{name}").columns) for name in ("trees", "bins", "medians", "calibrators", "manifest"))
    return a.join(b, ["id", "learner"]).groupBy("learner").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_a") != F.col("_b")).alias("different"),
                                                              F.lit(int(min(1, sizes.get(boosting.FIT, 0)))).cast("bigint").alias("has_fit"), F.lit(tables).cast("bigint").alias("tables"))


@query("snk04_prediction_export")
def prediction_export(t: Tables) -> DataFrame:
    """Per-model class probabilities written as Parquet and read back."""
    from barwright.sources.sinks import write_parquet
    path = f"{ensure_checkpoint_dir(t.spark)}/predictions-{uuid.uuid4().hex}"
    flat = oof(t).select("id", "fold", "learner", *[F.col("p")[i].alias(f"p_{n.lower()}") for i, n in enumerate(L.CLASSES)])
    write_parquet(flat, path)
    return t.spark.read.parquet(path).groupBy("learner").agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg("p_up")).alias("mean_p_up"))
