"""Walk-forward, economic and opportunity campaign queries on line items as a seven-year trade ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barwright.functions.numeric import count_where, failed_names, rounded
from barwright.operators import conditions as C, effects as E, resampling as R, stability as S, walkforward as W
from barwright.operators.quantiles import exact_quantiles
from barwright.plans.bindings import Tables, rounded_all
from barwright.plans.evidence import p_sql, policy_sql, signal_sql
from barwright.plans.features import ESQL, experiences
from barwright.plans.oracle import r
from barwright.plans.registry import query
from barwright.plans.stability import attack_sql, reasons_sql
from barwright.session import materialize

FIRST, PURGE, EMBARGO = 1996, 30, 30
SIGNALS = [{"id": "LARGE", "field": "state_return_5", "operator": "gte", "threshold": 0.4, "action": "LONG", "horizon": 5},
           {"id": "SMALL", "field": "state_dist_low", "operator": "lte", "threshold": 0.3, "action": "LONG", "horizon": 3},
           {"id": "NEGATIVE", "field": "state_return_5", "operator": "lte", "threshold": -0.4, "action": "SHORT", "horizon": 5},
           {"id": "NEAR", "field": "state_dist_high", "operator": "lte", "threshold": 0.41, "action": "SHORT", "horizon": 3}]

LEDGER = """WITH led AS (SELECT l_orderkey, l_linenumber, l_shipdate AS ts, l_shipdate::DATE::VARCHAR AS session_id, (l_quantity - 25.5) / 25 AS state_return_5, l_quantity / 50 AS state_dist_low, 1 - l_quantity / 50 AS state_dist_high,
 l_tax * 100 AS state_spread_points, l_tax / 4 AS state_spread_price, l_extendedprice / 1e5 AS state_atr, l_extendedprice / 1e5 + l_quantity / 100 AS state_vol_short, l_orderkey % 271 AS minute,
 CASE l_returnflag WHEN 'R' THEN 'RANGE' WHEN 'A' THEN 'TREND_UP' ELSE 'TREND_DOWN' END AS state_regime, l_discount - 0.03 AS g, l_tax / 4 AS cost, l_discount AS up, l_tax - 0.08 AS down FROM lineitem)"""


def ledger(t: Tables) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("session_id"), ((q - 25.5) / 25).alias("state_return_5"),
        (q / 50).alias("state_dist_low"), (1 - q / 50).alias("state_dist_high"), (F.col("l_tax") * 100).alias("state_spread_points"), (F.col("l_tax") / 4).alias("state_spread_price"),
        (p / 1e5).alias("state_atr"), (p / 1e5 + q / 100).alias("state_vol_short"), F.pmod("l_orderkey", F.lit(271)).alias("minute"),
        F.when(F.col("l_returnflag") == "R", "RANGE").when(F.col("l_returnflag") == "A", "TREND_UP").otherwise("TREND_DOWN").alias("state_regime"),
        (F.col("l_discount") - 0.03).alias("g"), (F.col("l_tax") / 4).alias("cost"), F.col("l_discount").alias("up"), (F.col("l_tax") - 0.08).alias("down"))


def folds_sql(source: str, ts: str = "ts") -> str:
    return f""", folds AS (SELECT *, CASE WHEN {ts} < make_timestamp(fold, 1, 1, 0, 0, 0) - INTERVAL 30 MINUTE THEN 'TRAIN' WHEN {ts} >= make_timestamp(fold, 1, 1, 0, 0, 0) + INTERVAL 30 MINUTE AND {ts} < make_timestamp(fold + 1, 1, 1, 0, 0, 0) THEN 'TEST' END AS role
 FROM {source} CROSS JOIN (SELECT unnest(range({FIRST}, (SELECT max(year({ts})) FROM {source}) + 1))::INT AS fold) y)"""


ORDERS = "WITH o AS (SELECT o_orderkey, o_orderdate AS ts FROM orders)" + folds_sql("o")
FOLD_SQL = ORDERS + """, ft AS (SELECT fold, count(*) FILTER (role = 'TRAIN') AS train_rows, count(*) FILTER (role = 'TEST') AS test_rows, max(CASE WHEN role = 'TRAIN' THEN ts END) AS train_last, min(CASE WHEN role = 'TEST' THEN ts END) AS test_first,
 max(CASE WHEN role = 'TEST' THEN ts END) AS test_last FROM folds WHERE role IS NOT NULL GROUP BY fold)"""


def tagged_orders(t: Tables) -> DataFrame:
    o = t.read("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return W.tag_folds(o, "ts", FIRST, PURGE, EMBARGO)


@query("w01_expanding_folds", FOLD_SQL + " SELECT *, train_rows > 0 AND test_rows > 0 AS usable FROM ft")
def folds(t: Tables) -> DataFrame:
    return W.fold_table(tagged_orders(t), "ts")


@query("w02_overlap_check", FOLD_SQL + " SELECT fold, train_last, test_first, train_last + INTERVAL 30 MINUTE >= test_first AS overlaps FROM ft")
def overlap(t: Tables) -> DataFrame:
    return W.overlap_violations(W.fold_table(tagged_orders(t), "ts"), PURGE).select("fold", "train_last", "test_first", "overlaps")


@query("w03_temporal_parts", ORDERS + """, d AS (SELECT fold, ts, row_number() OVER (PARTITION BY fold ORDER BY ts) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM folds WHERE role = 'TRAIN'),
 f AS (SELECT fold, ts, min(rn) - 1 AS before, max(n) AS n, count(*) AS k FROM d GROUP BY fold, ts),
 g AS (SELECT *, CASE WHEN before < greatest(1, floor(n * 0.7)) THEN 'FIT' WHEN before < greatest(greatest(1, floor(n * 0.7)) + 1, floor(n * 0.85)) THEN 'STOP' ELSE 'CALIBRATE' END AS part FROM f)
 SELECT fold, part, sum(k)::BIGINT AS "rows", min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY ALL""")
def parts(t: Tables) -> DataFrame:
    train = tagged_orders(t).where(F.col("role") == "TRAIN")
    out = W.temporal_parts(train, "ts", ["fold"])
    return out.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _entries_sql() -> str:
    parts = []
    for s in SIGNALS:
        sign = "" if s["action"] == "LONG" else "-"
        fired = f"f_{s['id'].lower()}"
        parts.append(f"{fired} AS (SELECT *, '{s['id']}' AS signal, {sign}g AS gross, {sign}g - cost AS net, {'up' if s['action'] == 'LONG' else '-down'} AS mfe, {'down' if s['action'] == 'LONG' else '-up'} AS mae, {signal_sql(s, C.magnitude_factor(s))} AS stronger FROM folds WHERE role IS NOT NULL AND {signal_sql(s)})")
        parts.append(f"q_{s['id'].lower()} AS (SELECT fold, quantile_cont(state_spread_points, 0.25) AS a, quantile_cont(state_vol_short, 0.25) AS b, quantile_cont(state_vol_short, 0.75) AS c, quantile_cont(state_spread_price / nullif(state_atr, 0), 0.25) AS d FROM {fired} WHERE role = 'TRAIN' GROUP BY fold)")
    unions = []
    for s in SIGNALS:
        rules = {"LOW_COST": "state_spread_points <= a", "HIGH_SIGNAL_MAGNITUDE": "stronger", "FAVORABLE_VOLATILITY": "state_vol_short BETWEEN b AND c",
                 "LOW_COST_ATR": "state_spread_price / nullif(state_atr, 0) <= d", "SELECTED_TIME_WINDOW": "minute BETWEEN 60 AND 210", "RANGE_REGIME": "state_regime = 'RANGE'"}
        for p, cond in rules.items():
            unions.append(f"SELECT x.*, '{p}' AS policy, coalesce({cond}, false) AS entered FROM f_{s['id'].lower()} x LEFT JOIN q_{s['id'].lower()} USING (fold) WHERE role = 'TEST'")
    return LEDGER + folds_sql("led") + ", " + ", ".join(parts) + ", ent AS (" + " UNION ALL ".join(unions) + ")"


ENT = _entries_sql()
OUTCOME = {"gross": "gross_{action}", "net": "net_{action}", "mfe": "mfe_{action}", "mae": "mae_{action}"}


def entries(t: Tables) -> DataFrame:
    """Test rows of all 24 (signal, policy) pairs with their decision."""
    def build() -> DataFrame:
        led = ledger(t)
        sided = led.withColumns({"gross_long": F.col("g"), "gross_short": -F.col("g"), "net_long": F.col("g") - F.col("cost"), "net_short": -F.col("g") - F.col("cost"),
                                 "mfe_long": F.col("up"), "mfe_short": -F.col("down"), "mae_long": F.col("down"), "mae_short": -F.col("up"),
                                 "cost_atr": F.try_divide("state_spread_price", "state_atr")})
        roled = W.fold_roles(sided, "ts", FIRST, PURGE, EMBARGO)
        needed = ["ts", "session_id", "state_spread_points", "state_vol_short", "cost_atr", "minute", "state_regime", "cost", "signal", "stronger",
                  *OUTCOME, *{s["field"] for s in SIGNALS}, "train_folds", "test_folds"]
        return W.policy_flags(W.signal_rows(roled, SIGNALS, OUTCOME).select(*needed), SIGNALS)
    return W.by_policy(t.stored("policy_flags", build))


SP = ["signal", "policy"]


@query("w04_policy_folds", ENT + f" SELECT signal, policy, fold, count(*) AS eligible, count(*) FILTER (entered) AS entered, count(*) FILTER (NOT entered) AS waited, {r('avg(CASE WHEN entered THEN net END)')} AS expected_net FROM ent GROUP BY ALL")
def policy_folds(t: Tables) -> DataFrame:
    return rounded_all(W.fold_results(entries(t), SP), ["expected_net"])


COST_QUANTILES = {"cost_p50": 0.5, "cost_p75": 0.75, "cost_p90": 0.9, "cost_p95": 0.95}
RESULT_DOUBLES = [*COST_QUANTILES, "expected_net", "break_even_cost", "expected_cost", "hit_rate", "payoff", "mfe", "mae", "stress_0_75", "stress_1_0", "stress_1_25", "stress_1_5", "stress_2_0", "entry_rate", "cost_to_gross"]
RESULTS = ENT + """, res AS (SELECT signal, policy, """ + ", ".join(f"quantile_cont(CASE WHEN entered THEN cost END, {q}) AS {name}" for name, q in COST_QUANTILES.items()) + """, count(*) AS eligible, count(*) FILTER (entered) AS entered, avg(CASE WHEN entered THEN net END) AS expected_net, avg(CASE WHEN entered THEN gross END) AS break_even_cost,
 avg(CASE WHEN entered THEN cost END) AS expected_cost, avg(CASE WHEN entered THEN (net > 0)::INT END) AS hit_rate, avg(CASE WHEN entered AND net > 0 THEN net END) / nullif(abs(avg(CASE WHEN entered AND net < 0 THEN net END)), 0) AS payoff,
 avg(CASE WHEN entered THEN mfe END) AS mfe, avg(CASE WHEN entered THEN mae END) AS mae, avg(CASE WHEN entered THEN gross - 0.75 * cost END) AS stress_0_75, avg(CASE WHEN entered THEN gross - cost END) AS stress_1_0, avg(CASE WHEN entered THEN gross - 1.25 * cost END) AS stress_1_25, avg(CASE WHEN entered THEN gross - 1.5 * cost END) AS stress_1_5, avg(CASE WHEN entered THEN gross - 2 * cost END) AS stress_2_0,
 count(DISTINCT CASE WHEN entered THEN session_id END) AS sessions, count(DISTINCT CASE WHEN entered THEN year(ts) END) AS years, count(*) FILTER (NOT entered) AS waited, count(*) FILTER (entered) / count(*) AS entry_rate FROM ent GROUP BY ALL),
 py AS (SELECT signal, policy, count(*) FILTER (m > 0) AS positive_years FROM (SELECT signal, policy, year(ts) AS y, avg(net) AS m FROM ent WHERE entered GROUP BY ALL) GROUP BY ALL),
 full_ AS (SELECT res.*, coalesce(positive_years, 0) AS positive_years, expected_cost / nullif(abs(break_even_cost), 0) AS cost_to_gross, years >= 3 AND coalesce(positive_years, 0) >= greatest(2, years - 1) AS stable FROM res LEFT JOIN py USING (signal, policy))"""


def results(t: Tables) -> DataFrame:
    def build() -> DataFrame:
        costs = exact_quantiles(entries(t).where("entered"), "cost", list(COST_QUANTILES.values()), by=SP, names=list(COST_QUANTILES), few_groups=True)
        return W.policy_results(entries(t), SP, "ts", (0.75, 1.0, 1.25, 1.5, 2.0)).join(costs, SP, "left")
    return t.stored("policy_results", build)


@query("w05_policy_results", RESULTS + " SELECT signal, policy, eligible, entered, sessions, years, positive_years, waited, stable, " + ", ".join(f"{r(c)} AS {c}" for c in RESULT_DOUBLES) + " FROM full_")
def policy_results(t: Tables) -> DataFrame:
    return rounded_all(results(t), RESULT_DOUBLES)


PERIOD_SQL = "signal, policy, year(ts)::INT::VARCHAR AS year, year(ts)::INT::VARCHAR || CASE WHEN month(ts) <= 6 THEN '-H1' ELSE '-H2' END AS half, state_regime"


@query("w05_policy_stability", ENT + f""", st AS (SELECT {PERIOD_SQL}, net FROM ent WHERE entered) SELECT signal, policy, kind, part, count(*) AS entered, {r('avg(net)')} AS mean_net FROM (SELECT signal, policy, 'YEAR' AS kind, year AS part, net FROM st
 UNION ALL SELECT signal, policy, 'HALF', half, net FROM st UNION ALL SELECT signal, policy, 'REGIME', state_regime, net FROM st) GROUP BY ALL""")
def policy_stability(t: Tables) -> DataFrame:
    """Mean net return of every policy by year, half-year and regime."""
    year = F.year("ts").cast("string")
    half = F.concat(year, F.when(F.month("ts") <= 6, F.lit("-H1")).otherwise(F.lit("-H2")))
    on = entries(t).where("entered").withColumns({"year": year, "half": half})
    # Rows become one per policy, half-year and regime first; the kinds of parts are sums of those.
    small = on.groupBy(*SP, "year", "half", "state_regime").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("s"))
    listed = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("part")) for kind, c in (("YEAR", "year"), ("HALF", "half"), ("REGIME", "state_regime"))])
    return small.select(*SP, "n", "s", F.inline(listed)).groupBy(*SP, "kind", "part").agg(F.sum("n").alias("entered"), rounded(F.sum("s") / F.sum("n")).alias("mean_net"))


GATE_NAMES = ("minimum_support_failed", "expected_net_return_not_positive", "ci95_not_positive", "temporal_stability_failed", "economic_skeptic_failed")
ATTACKS = ("remove_best_5pct", "remove_best_sessions", "winsorised", "cost_1_5x", "spread_10pct", "mean", "stronger_signal")
CAMPAIGN = RESULTS + """, cm AS (SELECT signal, policy, avg(net) AS mean, count(*) AS n FROM ent WHERE entered GROUP BY ALL), cs AS (SELECT signal, policy, session_id, sum(net) AS sv, count(*) AS k FROM ent WHERE entered GROUP BY ALL),
 ci AS (SELECT signal, policy, max(mean) AS mean, sqrt(sum((sv - mean * k) * (sv - mean * k)) * count(*) / nullif(count(*) - 1, 0)) / max(n) AS se FROM cs JOIN cm USING (signal, policy) GROUP BY ALL),
 pv AS (SELECT signal, policy, signal || '-' || policy AS id, mean AS mu, se, round(""" + p_sql("mean", "se") + """, 6) AS p FROM ci), rk AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM pv),
 bh AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC)) AS q FROM rk), e AS (SELECT *, signal || '-' || policy AS id FROM ent WHERE entered)""" + attack_sql("id") + """,
 tx AS (SELECT id, avg(gross - 1.5 * cost) AS cost_1_5x, avg(gross - 1.1 * cost) AS spread_10pct, avg(CASE WHEN stronger THEN net END) AS stronger_signal, count(*) FILTER (gross IS NULL) = 0 AS gap_free FROM e GROUP BY id),
 rg AS (SELECT id, count(*) AS regimes, count(*) FILTER (m > 0) AS positive_regimes FROM (SELECT id, state_regime, avg(net) AS m FROM e GROUP BY ALL) GROUP BY id),
 sk AS (SELECT id, """ + " AND ".join(f"coalesce({c} > 0, false)" for c in ATTACKS) + """ AND coalesce(temporal_concentration <= 0.6, true) AND gap_free AND (regimes <= 1 OR positive_regimes >= 2) AS skeptic_passed FROM att JOIN conc USING (id) JOIN tx USING (id) JOIN rg USING (id)),
 gt AS (SELECT f.*, id, mu, se, q, """ + reasons_sql(list(zip(GATE_NAMES, ("entered >= 100 AND sessions >= 50 AND years >= 3", "expected_net > 0", "mu - 1.96 * se > 0", "stable", "skeptic_passed")))) + """ AS gates FROM full_ f JOIN bh USING (signal, policy) JOIN sk USING (id)),
 fin AS (SELECT *, CASE WHEN len(gates) = 0 AND q > 0.05 THEN ['bh_fdr_failed'] ELSE gates END AS reasons, CASE WHEN len(gates) = 0 AND q <= 0.05 THEN 'DEV_ECONOMIC_SURVIVOR' ELSE 'REJECTED' END AS status,
  round(0.45 * (1 - q) + 0.25 * least(1.0, sessions / 500) + 0.2 * greatest(0.0, 1 - (2 * 1.96 * se) / 0.002) - 0.08, 6) AS research_value FROM gt)"""


def campaign(t: Tables) -> DataFrame:
    """Every (signal, policy) with its gates, the skeptic among them, FDR, reasons and status."""
    def build() -> DataFrame:
        on = entries(t).where("entered")
        ci = E.clustered_mean(on, SP, "net").withColumn("p", F.round("p_value", 6)).select(*SP, "mean", "se", "ci_low", "p")
        attacked = S.economic_skeptic(on, SP, F.col("stronger")).select(*SP, F.col("passed").alias("skeptic_passed"))
        both = results(t).join(ci, SP).join(attacked, SP).withColumn("id", F.concat_ws("-", "signal", "policy")).withColumn("_all", F.lit(1))
        q = R.benjamini_hochberg(both, "p", ["_all"], "id", "q").drop("_all")
        checks = zip(GATE_NAMES, ((F.col("entered") >= 100) & (F.col("sessions") >= 50) & (F.col("years") >= 3), F.col("expected_net") > 0, F.col("ci_low") > 0, F.col("stable"), F.col("skeptic_passed")))
        value = 0.45 * (1 - F.col("q")) + 0.25 * F.least(F.lit(1.0), F.col("sessions") / 500) + 0.2 * F.greatest(F.lit(0.0), 1 - (2 * 1.96 * F.col("se")) / 0.002) - 0.08
        # The false discovery rate is asked only of those that pass everything else.
        late = (F.size("_gates") == 0) & (F.col("q") > 0.05)
        q = q.withColumn("_gates", failed_names(list(checks)))
        q = q.withColumn("reasons", F.when(late, F.array(F.lit("bh_fdr_failed"))).otherwise(F.col("_gates"))).drop("_gates")
        return q.withColumns({"status": F.when(F.size("reasons") == 0, F.lit("DEV_ECONOMIC_SURVIVOR")).otherwise(F.lit("REJECTED")), "research_value": F.round(value, 6)})
    return t.stored("campaign", build)


@query("w06_campaign_ranking", CAMPAIGN + f" SELECT id, {r('q')} AS q_value, status, array_to_string(reasons, ',') AS reasons, {r('research_value', 4)} AS research_value, row_number() OVER (ORDER BY round(research_value, 4) DESC, id) AS research_rank, row_number() OVER (ORDER BY CASE WHEN status = 'REJECTED' THEN 0 ELSE greatest(0, round(expected_net, 6)) END DESC, id) AS trade_rank FROM fin")
def ranking(t: Tables) -> DataFrame:
    from pyspark.sql import Window
    c = campaign(t)
    trade = F.when(F.col("status") == "REJECTED", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.round("expected_net", 6)))
    return c.select("id", rounded("q").alias("q_value"), "status", F.concat_ws(",", "reasons").alias("reasons"), rounded("research_value", 4).alias("research_value"),
                    F.row_number().over(Window.orderBy(F.round("research_value", 4).desc(), "id")).alias("research_rank"),
                    F.row_number().over(Window.orderBy(trade.desc(), "id")).alias("trade_rank"))


@query("w06_status_counts", CAMPAIGN + " SELECT status, coalesce(reason, '') AS reason, count(*) AS policies FROM (SELECT status, unnest(CASE WHEN len(reasons) = 0 THEN [NULL] ELSE reasons END) AS reason FROM fin) GROUP BY ALL")
def status_counts(t: Tables) -> DataFrame:
    """How often each status and each reason occurs."""
    return campaign(t).select("status", F.explode_outer("reasons").alias("reason")).groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("policies"))


@query("w17_campaign_consolidation", CAMPAIGN + " SELECT signal AS family, count(*) FILTER (status = 'DEV_ECONOMIC_SURVIVOR') AS \"DEV_ECONOMIC_SURVIVOR\", count(*) FILTER (status = 'REJECTED') AS \"REJECTED\" FROM fin GROUP BY signal")
def consolidation(t: Tables) -> DataFrame:
    return W.consolidate(campaign(t).withColumn("family", F.col("signal")), ["DEV_ECONOMIC_SURVIVOR", "REJECTED"])


# ---- opportunity -------------------------------------------------------------------------------------

HORIZONS, K = (1, 3, 5), 3.0
OPP_SQL = ESQL + """, opp AS (SELECT *, greatest(abs(label_up_5), abs(label_down_5)) AS max_excursion, coalesce(greatest(abs(label_up_5), abs(label_down_5)) >= 3 * cost_5, false) AS large, greatest(abs(label_up_5), abs(label_down_5)) - 3 * cost_5 AS surplus,
 CASE WHEN greatest(abs(label_up_1), abs(label_down_1)) >= 3 * cost_5 THEN 1 WHEN greatest(abs(label_up_3), abs(label_down_3)) >= 3 * cost_5 THEN 3 WHEN greatest(abs(label_up_5), abs(label_down_5)) >= 3 * cost_5 THEN 5 END AS time_to_excursion FROM exps WHERE action = 'LONG')"""


def opportunities(t: Tables) -> DataFrame:
    return W.opportunity_labels(experiences(t).where(F.col("action") == "LONG"), 5, K, HORIZONS, "cost_5")


@query("w07_opportunity_labels", OPP_SQL + f" SELECT ts, {r('max_excursion')} AS max_excursion, large, {r('surplus')} AS surplus, time_to_excursion FROM opp")
def opportunity_labels(t: Tables) -> DataFrame:
    return opportunities(t).select("ts", rounded("max_excursion").alias("max_excursion"), "large", rounded("surplus").alias("surplus"), "time_to_excursion")


@query("w10_cost_reality", LEDGER + f""", q AS (SELECT quantile_cont(state_vol_short, 0.25) AS a, quantile_cont(state_vol_short, 0.5) AS b, quantile_cont(state_vol_short, 0.75) AS c FROM led), x AS (SELECT cost, 'MINUTE' AS kind, (minute // 30 * 30)::VARCHAR AS bucket FROM led UNION ALL SELECT cost, 'REGIME', state_regime FROM led
 UNION ALL SELECT cost, 'VOLATILITY', CASE WHEN state_vol_short <= a THEN 'Q1' WHEN state_vol_short <= b THEN 'Q2' WHEN state_vol_short <= c THEN 'Q3' ELSE 'Q4' END FROM led, q) SELECT kind, bucket, count(*) AS "rows", {r('avg(cost)')} AS mean_cost FROM x GROUP BY ALL
 UNION ALL SELECT 'PERCENTILE', 'p' || p, count(*), {r('quantile_cont(cost, 0.5)')} FROM led, (VALUES ('50')) v(p) GROUP BY p UNION ALL SELECT 'PERCENTILE', 'p90', count(*), {r('quantile_cont(cost, 0.9)')} FROM led""")
def cost_reality(t: Tables) -> DataFrame:
    led = ledger(t)
    edges = C.learn_thresholds(led, {("state_vol_short", 0.25), ("state_vol_short", 0.5), ("state_vol_short", 0.75)})
    from barwright.operators.quantiles import attach
    v = F.col("state_vol_short")
    quartile = (F.when(v <= F.col(C.threshold_name("state_vol_short", 0.25)), "Q1").when(v <= F.col(C.threshold_name("state_vol_short", 0.5)), "Q2")
                 .when(v <= F.col(C.threshold_name("state_vol_short", 0.75)), "Q3").otherwise("Q4"))
    listed = F.array(F.struct(F.lit("MINUTE").alias("kind"), (F.floor(F.col("minute") / 30) * 30).cast("string").alias("bucket")),
                     F.struct(F.lit("REGIME").alias("kind"), F.col("state_regime").alias("bucket")), F.struct(F.lit("VOLATILITY").alias("kind"), quartile.alias("bucket")))
    buckets = attach(led, edges).select("cost", F.inline(listed)).groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg("cost")).alias("mean_cost"))
    ps = exact_quantiles(led, "cost", [0.5, 0.9], names=["p50", "p90"])
    total = led.agg(F.count(F.lit(1)).alias("rows"))
    rows = attach(ps, total).select(F.lit("PERCENTILE").alias("kind"), F.stack(F.lit(2), F.lit("p50"), F.col("p50"), F.lit("p90"), F.col("p90")).alias("bucket", "mean_cost"), "rows")
    return buckets.unionByName(rows.withColumn("mean_cost", rounded("mean_cost")))


@query("w11_trade_value", f"""WITH g AS (SELECT l_suppkey, count(*) AS support, avg(l_discount - 0.03) AS expected_gross, avg(l_tax / 4) AS expected_cost, avg(l_discount - 0.03 - l_tax / 4) AS expected_net, CASE WHEN count(*) > 1 THEN stddev_samp(l_discount - 0.03 - l_tax / 4) / sqrt(count(*)) END AS uncertainty,
 quantile_cont(l_discount - 0.03 - l_tax / 4, 0.05) AS downside_p05 FROM lineitem GROUP BY 1) SELECT l_suppkey, support, {', '.join(f'{r(c)} AS {c}' for c in ('expected_gross', 'expected_cost', 'expected_net', 'uncertainty', 'downside_p05'))}, {r('expected_net - 1.96 * uncertainty')} AS ci_low,
 {r('expected_net + 1.96 * uncertainty')} AS ci_high, CASE WHEN support >= 100 AND coalesce(expected_net - 1.96 * uncertainty, 0) > 0 THEN 'ENTER_LONG' ELSE 'WAIT' END AS decision FROM g""")
def trade_value(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select("l_suppkey", (F.col("l_discount") - 0.03).alias("gross"), (F.col("l_tax") / 4).alias("cost"))
    v = W.trade_value(rows, ["l_suppkey"], "gross", "cost", "LONG", 100)
    down = exact_quantiles(rows, F.col("gross") - F.col("cost"), [0.05], by=["l_suppkey"], names=["downside_p05"])
    return rounded_all(v.join(down, "l_suppkey"), ["expected_gross", "expected_cost", "expected_net", "uncertainty", "ci_low", "ci_high", "downside_p05"])


@query("w12_abstention", f"WITH g AS (SELECT l_suppkey, avg(l_discount - 0.05) AS e FROM lineitem GROUP BY 1) SELECT l_suppkey, {r('e')} AS expected_net, {r('0 - e')} AS abstention_value, CASE WHEN 0 - e >= 0 THEN 'WAIT' ELSE 'ENTER' END AS optimal_action FROM g")
def abstention(t: Tables) -> DataFrame:
    g = t.read("lineitem").groupBy("l_suppkey").agg(F.avg(F.col("l_discount") - 0.05).alias("expected_net"))
    return rounded_all(W.abstention(g), ["expected_net", "abstention_value"])


@query("w13_edge_and_value", f"""WITH g AS (SELECT l_suppkey, avg(l_discount) AS move, avg(CASE WHEN l_tax > 0.04 THEN l_tax / 4 ELSE 0 END) AS cost, avg((l_quantity > 25)::INT) / 4 AS frequency, stddev_samp(l_discount) AS uncertainty, 1 AS complexity FROM lineitem GROUP BY 1)
 SELECT l_suppkey, {r('move / nullif(cost, 0)', 4)} AS edge_to_cost, {r('greatest(0.0, 0.45 * least(1.0, move / nullif(cost, 0) / 3) + 0.25 * least(1.0, greatest(0.0, frequency) / 0.1) + 0.2 * greatest(0.0, 1 - least(1.0, uncertainty / 0.25)) - 0.08 * complexity)')} AS opportunity_value FROM g""")
def edge_and_value(t: Tables) -> DataFrame:
    g = t.read("lineitem").groupBy("l_suppkey").agg(
        F.avg("l_discount").alias("move"), F.avg(F.when(F.col("l_tax") > 0.04, F.col("l_tax") / 4).otherwise(0.0)).alias("cost"),
        (F.avg((F.col("l_quantity") > 25).cast("double")) / 4).alias("frequency"), F.stddev_samp("l_discount").alias("uncertainty"), F.lit(1).alias("complexity"))
    return g.select("l_suppkey", rounded(W.edge_to_cost(F.col("move"), F.col("cost")), 4).alias("edge_to_cost"),
                    rounded(W.opportunity_value("move", "cost", "frequency", "uncertainty", "complexity")).alias("opportunity_value"))


# Candidates from parts: brand is the family, (type, size) the condition; small parts are the registry.
CAND = """WITH p AS (SELECT p_partkey AS id, p_brand AS family, p_type AS condition, p_size AS target, p_name AS action, p_retailprice AS price FROM part),
 reg AS (SELECT *, CASE WHEN target % 3 = 0 THEN 'REJECTED' ELSE 'DEV_SURVIVOR' END AS status FROM p WHERE price < 930), rj AS (SELECT family, count(*) AS n FROM reg WHERE status = 'REJECTED' GROUP BY 1),
 fresh AS (SELECT p.*, least(1.0, coalesce(n, 0) / 4.0) AS saturation FROM p LEFT JOIN rj USING (family) WHERE (family, condition, target, action) NOT IN (SELECT (family, condition, target, action) FROM reg)),
 sc AS (SELECT *, (0.22 * 0.8 + 0.16 * 0.75 + 0.13 * CASE WHEN target < 25 THEN 0.55 ELSE 0.85 END + 0.12 * 0.3 + 0.12 * CASE WHEN price > 970 THEN 1.0 ELSE 0.65 END + 0.10 * 0.9 + 0.08 * (1 - 0.15) + 0.07 * (1 - 0.4)) AS gain, (0.45 * 0.05 + 0.30 * saturation + 0.25 * (target / 100.0)) AS pen FROM fresh)"""


@query("w15_candidate_ranking", CAND + f" SELECT id, family, {r('saturation')} AS saturation, {r('least(greatest(gain * (1 - 0.7 * pen), 0), 1)', 5)} AS score FROM sc ORDER BY round(least(greatest(gain * (1 - 0.7 * pen), 0), 1), 6) DESC, id LIMIT 50")
def candidate_ranking(t: Tables) -> DataFrame:
    p = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), F.col("p_type").alias("condition"), F.col("p_size").alias("target"), F.col("p_name").alias("action"), F.col("p_retailprice").alias("price"))
    reg = p.where(F.col("price") < 930).withColumn("status", F.when(F.pmod("target", F.lit(3)) == 0, "REJECTED").otherwise("DEV_SURVIVOR"))
    cand = p.withColumns({"information_gain": F.lit(0.8), "uncertainty_reduction": F.lit(0.75), "novelty": F.when(F.col("target") < 25, 0.55).otherwise(0.85), "contradiction": F.lit(0.3),
                          "economic": F.when(F.col("price") > 970, 1.0).otherwise(0.65), "data_quality": F.lit(0.9), "prior_evidence": F.lit(0.15), "compute_cost": F.lit(0.4),
                          "redundancy": F.lit(0.05), "complexity": F.col("target") / 100})
    out = W.rank_candidates(cand, reg, ["family", "condition", "target", "action"], 50)
    return out.select("id", "family", rounded("saturation").alias("saturation"), rounded("score", 5).alias("score"))
