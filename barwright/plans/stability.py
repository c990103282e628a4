"""Stability, stress and falsification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barwright.functions.numeric import rounded
from barwright.operators import conditions as C, effects as E, resampling as R, stability as S
from barwright.plans.bindings import QUARTER, Tables, rounded_all
from barwright.plans.evidence import (BY, WINDOW_FLIPS, HIGH_VOL, MAIN, MEANS_SQL, PLACED, QSQL, TARGET, flips_sql, condition_sql, effect_sample,
                                      evidence_sql, stacked, states)
from barwright.plans.features import ESQL, experiences
from barwright.plans.oracle import r
from barwright.plans.registry import REGISTRY, query
from barwright.session import materialize

# Orders as a dated fact of seven years: urgent orders against the others, per order date.
ORDERS = """WITH o AS (SELECT o_orderdate AS ts, o_orderdate::VARCHAR AS session_id, o_orderstatus AS status, coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS c, o_totalprice / 1e5 AS v FROM orders),
p AS (SELECT *, year(ts)::INT::VARCHAR AS period FROM o UNION ALL SELECT *, year(ts)::INT::VARCHAR || CASE WHEN month(ts) <= 6 THEN '-H1' ELSE '-H2' END FROM o)"""


def grouped_effect_sql(source: str, by: str) -> str:
    """Paired-or-unpaired effect per group, straight from rows."""
    return f""", gm AS (SELECT {by}, session_id, avg(CASE WHEN c THEN v END) AS a, avg(CASE WHEN NOT c THEN v END) AS b FROM {source} WHERE v IS NOT NULL GROUP BY {by}, session_id),
ge AS (SELECT {by}, count(a - b) AS paired_sessions, count(*) AS sessions_seen, CASE WHEN count(a - b) >= greatest(20, floor(0.25 * count(*))) THEN avg(a - b) ELSE avg(a) - avg(b) END AS effect FROM gm GROUP BY {by})"""


def orders(t: Tables) -> DataFrame:
    o = t.read("orders")
    return o.select(F.col("o_orderdate").alias("ts"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("session_id"), F.col("o_orderstatus").alias("status"),
                    F.coalesce(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(False)).alias("condition"), (F.col("o_totalprice") / 1e5).alias("value"))


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    out = E.effect_summary(E.session_means(rows.where(F.col("value").isNotNull()), by), by)
    return out.select(*by, "paired_sessions", "sessions_seen", "effect")


PERIODS = ORDERS + grouped_effect_sql("p", "period")


@query("t01_period_effects", PERIODS + f" SELECT period, paired_sessions, sessions_seen, {r('effect')} AS effect FROM ge")
def period_effects(t: Tables) -> DataFrame:
    return rounded_all(grouped(S.period_rows(orders(t), "ts"), ["period"]), ["effect"])


@query("t02_regime_effects", QSQL + f", x AS (SELECT state_regime AS regime, session_id, {condition_sql(HIGH_VOL)} AS c, {TARGET} AS v FROM states)" + grouped_effect_sql("x", "regime") +
       f" SELECT regime, paired_sessions, sessions_seen, {r('effect')} AS effect FROM ge")
def regime_effects(t: Tables) -> DataFrame:
    rows = stacked(t, MAIN, ("session_id", "state_regime")).withColumnRenamed("state_regime", "regime")
    return rounded_all(grouped(rows, ["regime"]), ["effect"])


@query("t03_sign_consistency", PERIODS + f" SELECT 'URGENT' AS hypothesis, {r('avg((effect > 0)::INT)')} AS favourable, count(*) AS periods FROM ge WHERE effect IS NOT NULL")
def sign_consistency(t: Tables) -> DataFrame:
    e = grouped(S.period_rows(orders(t), "ts"), ["period"]).withColumn("hypothesis", F.lit("URGENT"))
    return rounded_all(S.sign_summary(e, BY), ["favourable"])


@query("t04_year_concentration", PERIODS + f" SELECT 'URGENT' AS hypothesis, {r('max(CASE WHEN len(period) = 4 THEN abs(effect) END) / sum(CASE WHEN len(period) = 4 THEN abs(effect) END)')} AS year_concentration, {r('stddev_pop(effect)')} AS dispersion FROM ge")
def year_concentration(t: Tables) -> DataFrame:
    e = grouped(S.period_rows(orders(t), "ts"), ["period"]).withColumn("hypothesis", F.lit("URGENT"))
    return rounded_all(S.concentration(e, BY, F.length("period") == 4), ["year_concentration", "dispersion"])


@query("t05_period_means", ORDERS + f" SELECT status, year(ts)::INT AS year, CASE WHEN month(ts) <= 6 THEN 'H1' ELSE 'H2' END AS half, {r('avg(v)')} AS mean, count(v) AS \"rows\" FROM o GROUP BY GROUPING SETS ((1, 2), (1, 2, 3))")
def period_means(t: Tables) -> DataFrame:
    return rounded_all(S.period_means(orders(t), ["status"], "ts", "value"), ["mean"])


MULTIPLIERS = (1.0, 1.25, 1.5, 2.0)


@query("t06_cost_stress", ESQL + f", x AS (SELECT m AS multiplier, session_id, {condition_sql(HIGH_VOL)} AS c, gross_5 - m * (gross_5 - net_5) AS v FROM exps CROSS JOIN (VALUES (1.0::DOUBLE), (1.25), (1.5), (2.0)) q(m) WHERE action = 'LONG')" +
       grouped_effect_sql("x", "multiplier") + f" SELECT multiplier::DOUBLE AS multiplier, paired_sessions, sessions_seen, {r('effect')} AS effect, effect > 0 AS favourable FROM ge")
def cost_stress(t: Tables) -> DataFrame:
    df = experiences(t).where(F.col("action") == "LONG")
    framed = C.with_thresholds(df, df, [HIGH_VOL]).withColumn("condition", C.condition(HIGH_VOL))
    rows = S.stress_multipliers(framed, "gross_5", "net_5", MULTIPLIERS).withColumn("value", F.col("stressed"))
    return rounded_all(grouped(rows, ["multiplier"]).withColumn("favourable", F.col("effect") > 0), ["effect"])


NEIGHBOURS = (0.65, 0.7, 0.75, 0.8, 0.85)


@query("t07_parameter_neighbours", QSQL + ", x AS (" + " UNION ALL ".join(
    f"SELECT 'Q{int(q * 100)}' AS neighbour, session_id, {condition_sql({**HIGH_VOL, 'quantile': q})} AS c, {TARGET} AS v FROM states" for q in NEIGHBOURS) + ")" + grouped_effect_sql("x", "neighbour") +
       f" SELECT neighbour, paired_sessions, sessions_seen, {r('effect')} AS effect FROM ge")
def neighbours(t: Tables) -> DataFrame:
    specs = [(f"Q{int(q * 100)}", "V", {**HIGH_VOL, "quantile": q}, TARGET, 1) for q in NEIGHBOURS]
    return rounded_all(grouped(stacked(t, specs).withColumnRenamed("hypothesis", "neighbour"), ["neighbour"]), ["effect"])


LAGGED = QSQL + ", lagged AS (SELECT *, " + ", ".join(f"lag({TARGET}, {s}) OVER (PARTITION BY minute ORDER BY ts) AS lagged_{s}" for s in (1, 5, 7, 10, 20)) + " FROM states)"


def lagged(t: Tables) -> DataFrame:
    return S.lag_within(states(t), ["symbol", "minute"], "ts", TARGET, (1, 5, 7, 10, 20))


def high_vol_rows(df: DataFrame, values: dict[str, str], base: DataFrame) -> DataFrame:
    """Condition rows for several target columns, thresholds from the full base sample."""
    framed = C.with_thresholds(df, base, [HIGH_VOL])
    return E.stack_hypotheses(framed, [(name, C.condition(HIGH_VOL), F.col(column)) for name, column in values.items()], ["session_id"])


@query("t08_slow_structure_control", LAGGED + f", x AS (SELECT 'SHIFT7' AS hypothesis, session_id, {condition_sql(HIGH_VOL)} AS c, lagged_7 AS v FROM lagged)" + grouped_effect_sql("x", "hypothesis") +
       f" SELECT hypothesis, paired_sessions, sessions_seen, {r('effect')} AS effect FROM ge")
def slow_control(t: Tables) -> DataFrame:
    return rounded_all(grouped(high_vol_rows(lagged(t), {"SHIFT7": "lagged_7"}, states(t)), BY), ["effect"])


RANDOM = {"type": "session_hash_mod", "modulus": 10, "remainder": 3}


@query("t09_negative_controls", LAGGED + f""", x AS (SELECT 'MAIN' AS hypothesis, session_id, {condition_sql(HIGH_VOL)} AS c, {TARGET} AS v FROM lagged UNION ALL SELECT 'SHIFT7', session_id, {condition_sql(HIGH_VOL)}, lagged_7 FROM lagged
  UNION ALL SELECT 'RANDOM', session_id, {condition_sql(RANDOM)}, {TARGET} FROM lagged)""" + grouped_effect_sql("x", "hypothesis") + f""", w AS (SELECT max(CASE hypothesis WHEN 'MAIN' THEN effect END) AS effect,
  max(CASE hypothesis WHEN 'SHIFT7' THEN effect END) AS shift_effect, max(CASE hypothesis WHEN 'RANDOM' THEN effect END) AS random_effect FROM ge)
SELECT {r('effect')} AS effect, {r('shift_effect')} AS shift_effect, {r('random_effect')} AS random_effect, {r('0.5 * greatest(abs(effect), 1e-12)')} AS control_limit,
  coalesce(abs(shift_effect) <= 0.5 * greatest(abs(effect), 1e-12), false) AND coalesce(abs(random_effect) <= 0.5 * greatest(abs(effect), 1e-12), false) AS passed FROM w""")
def negative_controls(t: Tables) -> DataFrame:
    framed = C.with_thresholds(lagged(t), states(t), [HIGH_VOL])
    rows = E.stack_hypotheses(framed, [("MAIN", C.condition(HIGH_VOL), F.col(TARGET)), ("SHIFT7", C.condition(HIGH_VOL), F.col("lagged_7")),
                                       ("RANDOM", C.condition(RANDOM), F.col(TARGET))], ["session_id"])
    one = grouped(rows, BY).agg(*[F.max(F.when(F.col("hypothesis") == h, F.col("effect"))).alias(n) for h, n in
                                  (("MAIN", "effect"), ("SHIFT7", "shift_effect"), ("RANDOM", "random_effect"))])
    out = one.withColumn("control_limit", S.negative_control_limit(F.col("effect"))).withColumn(
        "passed", S.negative_control_passed(F.col("effect"), [F.col("shift_effect"), F.col("random_effect")]))
    return rounded_all(out, ["effect", "shift_effect", "random_effect", "control_limit"])


SKEPTIC_SQL = """, k AS (SELECT *, count(*) OVER (PARTITION BY hypothesis) AS n, row_number() OVER (PARTITION BY hypothesis ORDER BY effect, session_id) AS up,
  row_number() OVER (PARTITION BY hypothesis ORDER BY abs(effect) DESC, session_id) AS big FROM eff), l AS (SELECT hypothesis, quantile_cont(effect, 0.05) AS lo, quantile_cont(effect, 0.95) AS hi FROM eff GROUP BY 1),
 sk AS (SELECT hypothesis, avg(least(greatest(effect, lo), hi)) AS winsorised, avg(CASE WHEN up <= n - greatest(1, floor(n * 0.05)) THEN effect END) AS drop_best, avg(CASE WHEN up > greatest(1, floor(n * 0.05)) THEN effect END) AS drop_worst,
  sum(CASE WHEN big <= greatest(1, floor(n * 0.05)) THEN abs(effect) END) / sum(abs(effect)) AS outlier_share FROM k JOIN l USING (hypothesis) GROUP BY hypothesis)"""


def _battery_sql(direction: str, sign: str) -> str:
    good = [f"({c} {sign} 0)::INT" for c in ("winsorised", "drop_best", "drop_worst")] + ["(outlier_share <= 0.5)::INT"]
    return f"""SELECT '{direction}' AS direction, sk.*, {' + '.join(good)} AS effect_attacks_survived, 8 AS attempted,
 {' + '.join(good)} + ((SELECT avg((m {sign} 0)::INT) FROM wk WHERE wk.hypothesis = sk.hypothesis) >= 0.6)::INT + (SELECT (effect {sign} 0)::INT FROM cs WHERE multiplier = 2) + (SELECT (NOT blocking)::INT FROM dq) + 1 AS survived FROM sk"""


@query("t10_skeptic_battery", evidence_sql(MAIN) + SKEPTIC_SQL + f""", wk AS (SELECT hypothesis, strftime(session_id::DATE, '%G-W%V') AS week, avg(effect) AS m FROM eff GROUP BY ALL), cs AS ({REGISTRY.sql['t06_cost_stress']}),
 dq AS (SELECT count(*) FILTER (least(open, high, low, close) <= 0) > 0 AS blocking FROM states), both_ AS ({_battery_sql('GREATER', '>')} UNION ALL {_battery_sql('LESS', '<')})
 SELECT direction, hypothesis, {r('winsorised')} AS winsorised, {r('drop_best')} AS drop_best, {r('drop_worst')} AS drop_worst, {r('outlier_share')} AS outlier_share, effect_attacks_survived, attempted, survived, {r('survived / attempted')} AS survival FROM both_""")
def skeptic(t: Tables) -> DataFrame:
    """All eight attacks on the volatility hypothesis, for either direction."""
    sample = materialize(effect_sample(t, MAIN))
    day = F.to_date("session_id")
    weeks = sample.groupBy(*BY, F.extract(F.lit("YEAROFWEEK"), day).alias("_y"), F.weekofyear(day).alias("_w")).agg(F.avg("effect").alias("_m"))
    stressed = cost_stress(t).where("multiplier = 2").select(F.col("effect").alias("_cost"))
    prices = states(t).agg((F.count_if(F.least("open", "high", "low", "close") <= 0) > 0).alias("_blocking"))
    out = None
    for direction, favourable in (("GREATER", lambda c: F.col(c) > 0), ("LESS", lambda c: F.col(c) < 0)):
        periods = weeks.groupBy(*BY).agg(F.avg(favourable("_m").cast("double")).alias("_periods"))
        facts = S.skeptic(sample, BY, direction=direction).join(periods, BY).join(stressed).join(prices)
        done = S.skeptic_survival(facts, F.col("_periods"), favourable("_cost"), F.col("_blocking")).withColumn("direction", F.lit(direction))
        out = done if out is None else out.unionByName(done)
    return rounded_all(out.drop("_periods", "_cost", "_blocking"), ["winsorised", "drop_best", "drop_worst", "outlier_share", "survival"])


# Line items as trades: the flag is the regime, the ship date the session.
TRADES = """WITH e AS (SELECT l_linestatus AS book, l_returnflag AS state_regime, l_shipdate::DATE::VARCHAR AS session_id, l_shipdate AS ts, l_discount - 0.03 AS gross, l_tax / 4 AS cost, l_discount - 0.03 - l_tax / 4 AS net, l_quantity >= 30 AS strong, l_quantity FROM lineitem)"""


def trades(t: Tables) -> DataFrame:
    gross, cost = F.col("l_discount") - 0.03, F.col("l_tax") / 4
    return t.read("lineitem").select(F.col("l_linestatus").alias("book"), F.col("l_returnflag").alias("state_regime"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("session_id"),
                                     F.col("l_shipdate").alias("ts"), gross.alias("gross"), cost.alias("cost"), (gross - cost).alias("net"), (F.col("l_quantity") >= 30).alias("strong"), "l_quantity")


def attack_sql(by: str, net: str = "net", trim: str = "net", source: str = "e") -> str:
    return f""", qs AS (SELECT {by}, quantile_cont({net}, 0.01) AS q01, quantile_cont({net}, 0.99) AS q99, quantile_cont({trim}, 0.95) AS q95 FROM {source} GROUP BY {by}),
ss AS (SELECT {by}, session_id, avg({net}) AS m, row_number() OVER (PARTITION BY {by} ORDER BY round(avg({net}), 12) DESC NULLS LAST, session_id) AS best, row_number() OVER (PARTITION BY {by} ORDER BY abs(round(avg({net}), 12)) DESC NULLS LAST, session_id) AS large FROM {source} GROUP BY {by}, session_id),
conc AS (SELECT {by}, sum(CASE WHEN large <= 10 THEN abs(m) END) / greatest(sum(abs(m)), 1e-15) AS temporal_concentration FROM ss GROUP BY {by}),
att AS (SELECT {by}, avg({net}) AS mean, avg(CASE WHEN {trim} < q95 THEN {net} END) AS remove_best_5pct, avg(CASE WHEN best > 10 THEN {net} END) AS remove_best_sessions, avg(CASE WHEN {net} IS NOT NULL THEN least(greatest({net}, q01), q99) END) AS winsorised,
  count(*) FILTER (best <= 10) / count(*) AS sample_concentration FROM {source} JOIN qs USING ({by}) JOIN ss USING ({by}, session_id) GROUP BY {by})"""


ATTACK_COLS = ["mean", "remove_best_5pct", "remove_best_sessions", "winsorised", "temporal_concentration", "sample_concentration"]
STRESS_COLS = ["cost_1_5x", "cost_2x", "spread_10pct", "stronger_signal"]


@query("t11_economic_skeptic", TRADES + attack_sql("book") + """, st AS (SELECT book, avg(gross - 1.5 * cost) AS cost_1_5x, avg(gross - 2 * cost) AS cost_2x, avg(gross - 1.1 * cost) AS spread_10pct, avg(CASE WHEN strong THEN net END) AS stronger_signal,
  count(*) FILTER (gross IS NULL) = 0 AS gap_free FROM e GROUP BY book), rg AS (SELECT book, count(*) AS regimes, count(*) FILTER (m > 0) AS positive_regimes FROM (SELECT book, state_regime, avg(net) AS m FROM e GROUP BY ALL) GROUP BY book),
w AS (SELECT * FROM att JOIN conc USING (book) JOIN st USING (book) JOIN rg USING (book))
SELECT book, """ + ", ".join(f"{r(c)} AS {c}" for c in ATTACK_COLS + STRESS_COLS) + """, gap_free, regimes, positive_regimes, array_to_string(list_filter([CASE WHEN NOT coalesce(remove_best_5pct > 0, false) THEN 'remove_best_5pct' END, CASE WHEN NOT coalesce(remove_best_sessions > 0, false) THEN 'remove_best_sessions' END,
  CASE WHEN NOT coalesce(winsorised > 0, false) THEN 'winsorised' END, CASE WHEN NOT coalesce(cost_1_5x > 0, false) THEN 'cost_1_5x' END, CASE WHEN NOT coalesce(spread_10pct > 0, false) THEN 'spread_10pct' END, CASE WHEN NOT coalesce(mean > 0, false) THEN 'mean' END,
  CASE WHEN NOT coalesce(stronger_signal > 0, false) THEN 'stronger_signal' END, CASE WHEN temporal_concentration > 0.6 THEN 'temporal_concentration' END, CASE WHEN NOT gap_free THEN 'gap_sensitivity' END,
  CASE WHEN regimes > 1 AND positive_regimes < 2 THEN 'regime_dependence' END], lambda x: x IS NOT NULL), ',') AS failures FROM w""")
def economic_skeptic(t: Tables) -> DataFrame:
    out = S.economic_skeptic(trades(t), ["book"], F.col("strong"))
    return rounded_all(out.withColumn("failures", F.concat_ws(",", "failures")).drop("passed"), ATTACK_COLS + STRESS_COLS)


def detrend_targets(t: Tables) -> DataFrame:
    df = states(t)
    for name, groups in (("by_week", [F.weekofyear("decision_ts")]), ("by_regime", [F.col("state_regime")]), ("by_minute", [F.col("minute")])):
        df = S.detrend(df, groups, TARGET, name)
    return df


VOLQ = condition_sql(HIGH_VOL)
DIAG = LAGGED + f""", det AS (SELECT *, {TARGET} - avg({TARGET}) OVER (PARTITION BY weekofyear(decision_ts)) AS by_week, {TARGET} - avg({TARGET}) OVER (PARTITION BY state_regime) AS by_regime, {TARGET} - avg({TARGET}) OVER (PARTITION BY minute) AS by_minute FROM lagged),
x AS (""" + " UNION ALL ".join(
    [f"SELECT 'ORIGINAL' AS hypothesis, session_id, {VOLQ} AS c, {TARGET} AS v FROM det"] + [f"SELECT 'SHIFT{s}', session_id, {VOLQ}, lagged_{s} FROM det" for s in (1, 5, 10, 20)]
    + [f"SELECT 'OFFSET{o}', session_id, {VOLQ}, CASE WHEN ((minute % 60) + 60) % 60 = {o} THEN {TARGET} END FROM det" for o in (0, 15, 30)]
    + [f"SELECT '{n.upper()}', session_id, {VOLQ}, {n} FROM det" for n in ("by_week", "by_regime", "by_minute")]
    + [f"SELECT 'HORIZON{h}', session_id, {VOLQ}, label_vol_{h} FROM det" for h in (3, 5, 10)]) + ")"


@query("t13_volatility_diagnostic", DIAG + grouped_effect_sql("x", "hypothesis") + f", gp AS (SELECT hypothesis, count(a - b) AS n, avg(a - b) AS effect FROM gm GROUP BY 1) SELECT hypothesis, n AS paired_sessions, {r('effect')} AS effect FROM gp WHERE n > 0")
def diagnostic(t: Tables) -> DataFrame:
    """Lags, sparse offsets, detrending and horizons of the volatility effect in one stacked aggregate."""
    slots = {f"lagged_{s}": F.lag(TARGET, s) for s in (1, 5, 10, 20)}
    df = S.lag_within(detrend_targets(t), ["symbol", "minute"], "ts", TARGET, (1, 5, 10, 20))
    framed = C.with_thresholds(df, states(t), [HIGH_VOL])
    mask = C.condition(HIGH_VOL)
    values = {"ORIGINAL": F.col(TARGET), **{f"SHIFT{n.split('_')[1]}": F.col(n) for n in slots},
              **{f"OFFSET{o}": F.when(F.pmod("minute", F.lit(60)) == o, F.col(TARGET)) for o in (0, 15, 30)},
              **{n.upper(): F.col(n) for n in ("by_week", "by_regime", "by_minute")}, **{f"HORIZON{h}": F.col(f"label_vol_{h}") for h in (3, 5, 10)}}
    rows = E.stack_hypotheses(framed, [(n, mask, v) for n, v in values.items()], ["session_id"])
    pairs = E.paired_effects(E.session_means(rows, BY), BY).groupBy(*BY).agg(F.count(F.lit(1)).alias("paired_sessions"), F.avg("effect").alias("effect"))
    return rounded_all(pairs, ["effect"])


@query("t14_residual_control", QSQL + f""", z AS (SELECT * FROM states WHERE state_vol_long IS NOT NULL AND state_vol_short IS NOT NULL AND {TARGET} IS NOT NULL),
 b AS (SELECT regr_slope(state_vol_short, state_vol_long) AS s1, regr_intercept(state_vol_short, state_vol_long) AS i1, regr_slope({TARGET}, state_vol_long) AS s2, regr_intercept({TARGET}, state_vol_long) AS i2 FROM z),
 rr AS (SELECT session_id, state_vol_short - (i1 + s1 * state_vol_long) AS f, {TARGET} - (i2 + s2 * state_vol_long) AS v FROM z, b), x AS (SELECT 'RESIDUAL' AS hypothesis, session_id, f >= (SELECT quantile_cont(f, 0.75) FROM rr) AS c, v FROM rr)""" +
       grouped_effect_sql("x", "hypothesis") + f" SELECT hypothesis, count(a - b) AS paired_sessions, {r('avg(a - b)', 5)} AS effect FROM gm GROUP BY 1")
def residual_control(t: Tables) -> DataFrame:
    res = materialize(S.residuals(states(t), "state_vol_long", {"state_vol_short": "feature_residual", TARGET: "target_residual"}))
    spec = {"type": "quantile_gte", "field": "feature_residual", "quantile": 0.75}
    framed = C.with_thresholds(res, res, [spec])
    rows = E.stack_hypotheses(framed, [("RESIDUAL", C.condition(spec), F.col("target_residual"))], ["session_id"])
    pairs = E.paired_effects(E.session_means(rows, BY), BY).groupBy(*BY).agg(F.count(F.lit(1)).alias("paired_sessions"), rounded(F.avg("effect"), 5).alias("effect"))
    return pairs


STARTS = list(range(0, 270, 15))
WIN = QSQL + ", hyp AS (" + " UNION ALL ".join(f"SELECT 'W{s:03d}' AS hypothesis, session_id, minute BETWEEN {s} AND {s + 14} AS c, {TARGET} AS v FROM states WHERE minute BETWEEN 0 AND 270 AND {TARGET} IS NOT NULL" for s in STARTS) + f""")
, means AS (SELECT hypothesis, session_id, avg(CASE WHEN c THEN v END) AS a, avg(CASE WHEN NOT c THEN v END) AS b FROM hyp GROUP BY ALL), eff AS (SELECT hypothesis, session_id, a - b AS effect FROM means WHERE a IS NOT NULL AND b IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY session_id) - 1 AS pos FROM eff), o AS (SELECT hypothesis, avg(effect) AS obs, count(*) AS sessions FROM eff GROUP BY 1),
nulls AS ({flips_sql('hypothesis', WINDOW_FLIPS)}),
pv AS (SELECT hypothesis, max(obs) AS obs, max(sessions) AS sessions, (count(*) FILTER (abs(mean) >= abs(obs) - 1e-12) + 1) / {WINDOW_FLIPS + 1}.0 AS p FROM nulls JOIN o USING (hypothesis) GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY p, hypothesis) AS k, count(*) OVER () AS m FROM pv)
SELECT hypothesis, sessions, {r('obs')} AS effect, {r('p')} AS p_value, {r('least(1.0, min(p * m / k) OVER (ORDER BY k DESC))')} AS fdr_p FROM rk"""


@query("t15_intraday_windows", WIN)
def intraday(t: Tables) -> DataFrame:
    """Eighteen equal windows, each against the rest of its session, with two-sided permutation and FDR."""
    inside = states(t).where(F.col("minute").between(0, 270))
    rows = E.stack_hypotheses(inside, [(f"W{s:03d}", F.col("minute").between(s, s + 14), F.col(TARGET)) for s in STARTS], ["session_id"])
    eff = materialize(R.positions(E.paired_effects(E.session_means(rows, BY), BY), BY, ["session_id"]))
    tests = R.sign_flip_test(eff, BY, WINDOW_FLIPS, F.col("hypothesis"), "TWO_SIDED")
    sizes = eff.groupBy(*BY).agg(F.count(F.lit(1)).alias("sessions"))
    out = R.benjamini_hochberg(tests.join(sizes, BY).withColumn("_all", F.lit(1)), "p_value", ["_all"], "hypothesis", "fdr_p")
    return out.select("hypothesis", "sessions", rounded("observed").alias("effect"), rounded("p_value").alias("p_value"), rounded("fdr_p").alias("fdr_p"))


@query("t16_replication_ratio", ORDERS + ", x AS (SELECT CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'DEV' ELSE 'VALIDATION' END AS part, status, session_id, c, v FROM o)" + grouped_effect_sql("x", "part, status") +
       f", w AS (SELECT status, max(CASE part WHEN 'DEV' THEN effect END) AS dev_effect, max(CASE part WHEN 'VALIDATION' THEN effect END) AS validation_effect FROM ge GROUP BY status) SELECT status, {r('dev_effect')} AS dev_effect, {r('validation_effect')} AS validation_effect, {r('validation_effect / nullif(dev_effect, 0)', 4)} AS replication_ratio FROM w")
def replication(t: Tables) -> DataFrame:
    rows = orders(t).withColumn("part", F.when(F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz"), F.lit("DEV")).otherwise(F.lit("VALIDATION")))
    e = grouped(rows, ["part", "status"])
    w = e.groupBy("status").agg(F.max(F.when(F.col("part") == "DEV", F.col("effect"))).alias("dev_effect"), F.max(F.when(F.col("part") != "DEV", F.col("effect"))).alias("validation_effect"))
    return w.select("status", rounded("dev_effect").alias("dev_effect"), rounded("validation_effect").alias("validation_effect"),
                    rounded(F.try_divide("validation_effect", "dev_effect"), 4).alias("replication_ratio"))


def reasons_sql(checks: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in checks) + "], lambda x: x IS NOT NULL)"
