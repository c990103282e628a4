"""Condition, effect, resampling and multiple-testing queries on the quarter-hour states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.numeric import rounded
from barwright.operators import conditions as C, effects as E, resampling as R
from barwright.operators.features import FeatureSpec
from barwright.plans import oracle
from barwright.plans.bindings import QUARTER, Tables, rounded_all
from barwright.plans.features import QSQL
from barwright.plans.registry import query
from barwright.session import materialize

TARGET = "label_vol_5"
HIGH_VOL = {"type": "quantile_gte", "field": "state_vol_short", "quantile": 0.75}
# Bootstrap resamples, permutations, and permutations of the intraday windows.
DRAWS, FLIPS, WINDOW_FLIPS = 2000, 4000, 1000
MEAN_BLOCK = 20

# A fixed catalogue of conditions: (id, family, condition, target, planned comparisons).
CATALOGUE = [
    *[(f"VOL-Q{int(q * 100)}", "VOLATILITY", {"type": "quantile_gte", "field": "state_vol_short", "quantile": q}, "label_vol_5", 3) for q in (0.5, 0.75, 0.9)],
    *[(f"LOWVOL-Q{int(q * 100)}", "VOLATILITY", {"type": "quantile_lte", "field": "state_vol_long", "quantile": q}, "label_vol_10", 2) for q in (0.1, 0.25)],
    *[(f"RANGE-Q{int(q * 100)}", "RANGE", {"type": "quantile_gte", "field": "state_bar_range", "quantile": q}, "label_vol_5", 2) for q in (0.75, 0.9)],
    *[(f"ATR-Q{int(q * 100)}", "RANGE", {"type": "quantile_gte", "field": "state_atr", "quantile": q}, "label_up_5", 2) for q in (0.25, 0.75)],
    *[(f"MOM-{s}", "MOMENTUM", {"type": f"quantile_{s}", "field": "state_momentum", "quantile": q}, "label_return_5", 4) for s, q in (("gte", 0.8), ("lte", 0.2))],
    *[(f"RET-{s}", "MOMENTUM", {"type": f"quantile_{s}", "field": "state_return_1", "quantile": q}, "label_return_1", 4) for s, q in (("gte", 0.9), ("lte", 0.1))],
    *[(f"DIST-{f}", "EXTREME", {"type": "quantile_lte", "field": f"state_dist_{f}", "quantile": 0.25}, "label_return_3", 2) for f in ("high", "low")],
    *[(f"TIME-{a}", "TEMPORAL", {"type": "minute_range", "field": "minute", "start": a, "end": a + 59}, "label_vol_5", 6) for a in (0, 60, 120, 180)],
    ("TIME-EQ-90", "TEMPORAL", {"type": "minute_equals", "field": "minute", "value": 90}, "label_return_5", 1),
    ("SPREAD-LOW", "LIQUIDITY", {"type": "quantile_lte", "field": "state_spread_points", "quantile": 0.25}, "label_return_5", 2),
    ("VOLUME-HIGH", "LIQUIDITY", {"type": "quantile_gte", "field": "state_tick_volume", "quantile": 0.75}, "label_vol_5", 2),
    ("REGIME-RANGE", "REGIME", {"type": "field_equals", "field": "state_regime", "value": "RANGE"}, "label_vol_5", 2),
    ("VOL-AND-UP", "REGIME", {"type": "all", "clauses": [HIGH_VOL, {"type": "field_equals", "field": "state_regime", "value": "TREND_UP"}]}, "label_return_5", 3),
]


def condition_sql(spec: dict, source: str = "states") -> str:
    """The same condition as SQL over a states relation, with inline quantiles."""
    kind = spec["type"]
    if kind == "all":
        return "(" + " AND ".join(condition_sql(c, source) for c in spec["clauses"]) + ")"
    f = spec.get("field")
    if kind.startswith("quantile_"):
        op = ">=" if kind.endswith("gte") else "<="
        return f"coalesce({f} {op} (SELECT quantile_cont({f}, {spec['quantile']}) FROM {source}), false)"
    if kind == "minute_equals":
        return f"({f} = {spec['value']})"
    if kind == "minute_range":
        return f"({f} BETWEEN {spec['start']} AND {spec['end']})"
    if kind == "field_equals":
        return f"coalesce({f} = '{spec['value']}', false)"
    return f"(('0x' || substr(md5(session_id), 1, 8))::BIGINT % {spec['modulus']} = {spec['remainder']})"


def states(t: Tables) -> DataFrame:
    return t.stored("states", lambda: t.frame(QUARTER))


def stacked(t: Tables, specs, keep=("session_id",)) -> DataFrame:
    """Hypothesis rows of a catalogue with all thresholds learned on the full sample."""
    df = states(t)
    framed = C.with_thresholds(df, df, [s[2] for s in specs])
    return E.stack_hypotheses(framed, [(s[0], C.condition(s[2]), F.col(s[3])) for s in specs], list(keep))


MAIN = [("VOL-Q75", "VOLATILITY", HIGH_VOL, TARGET, 3)]
UNPAIRED = [("TIME-EQ", "TEMPORAL", {"type": "session_hash_mod", "modulus": 3, "remainder": 0}, TARGET, 1)]
BY = ["hypothesis"]


def stack_sql(specs, extra: str = "", source: str = "states") -> str:
    return " UNION ALL ".join(f"SELECT '{s[0]}' AS hypothesis, session_id, {condition_sql(s[2], source)} AS c, {s[3]} AS v{extra} FROM {source} WHERE {s[3]} IS NOT NULL" for s in specs)


MEANS_SQL = """, means AS (SELECT hypothesis, session_id, avg(CASE WHEN c THEN v END) AS conditioned, avg(CASE WHEN NOT c THEN v END) AS baseline, count(*) AS n FROM hyp GROUP BY ALL),
summ AS (SELECT hypothesis, count(*) AS sessions_seen, count(conditioned - baseline) AS paired_sessions, count(conditioned) AS conditioned_sessions, count(baseline) AS baseline_sessions,
  avg(conditioned - baseline) AS pe, avg(CASE WHEN baseline IS NOT NULL THEN conditioned END) AS pc, avg(CASE WHEN conditioned IS NOT NULL THEN baseline END) AS pb,
  avg(conditioned) AS uc, avg(baseline) AS ub, sum(n)::BIGINT AS "rows", count(conditioned - baseline) >= greatest(20, floor(0.25 * count(*))) AS paired FROM means GROUP BY hypothesis),
eff AS (SELECT m.hypothesis, session_id, 'PAIR' AS side, conditioned - baseline AS effect FROM means m JOIN summ s USING (hypothesis) WHERE paired AND conditioned IS NOT NULL AND baseline IS NOT NULL
  UNION ALL SELECT m.hypothesis, session_id, 'CONDITIONED', conditioned - ub FROM means m JOIN summ s USING (hypothesis) WHERE NOT paired AND conditioned IS NOT NULL
  UNION ALL SELECT m.hypothesis, session_id, 'BASELINE', uc - baseline FROM means m JOIN summ s USING (hypothesis) WHERE NOT paired AND baseline IS NOT NULL)"""


def evidence_sql(specs) -> str:
    return QSQL + ", hyp AS (" + stack_sql(specs) + ")" + MEANS_SQL


SUMMARY_COLS = f"""sessions_seen, paired_sessions, conditioned_sessions, baseline_sessions, "rows", paired, {oracle.r('CASE WHEN paired THEN pe ELSE uc - ub END')} AS effect,
  {oracle.r('CASE WHEN paired THEN pc ELSE uc END')} AS conditioned_mean, {oracle.r('CASE WHEN paired THEN pb ELSE ub END')} AS baseline_mean,
  (CASE WHEN paired THEN paired_sessions ELSE conditioned_sessions + baseline_sessions END) AS sessions"""


def summary(t: Tables, specs) -> DataFrame:
    return E.effect_summary(E.session_means(stacked(t, specs), BY), BY)


def rounded_summary(df: DataFrame) -> DataFrame:
    return rounded_all(df, ["effect", "conditioned_mean", "baseline_mean"])


def flagship(t: Tables) -> DataFrame:
    """Per session: volatility after high-volatility bars against the rest, with the overall effect beside it."""
    df = materialize(t.frame(_flag_spec()))
    framed = C.with_thresholds(df, df, [HIGH_VOL])
    rows = E.stack_hypotheses(framed, [("HIGH_VOLATILITY", C.condition(HIGH_VOL), F.col(TARGET))], ["session_id"])
    means = materialize(E.session_means(rows, BY))
    total = E.effect_summary(means, BY).select("hypothesis", "effect", "paired", "paired_sessions")
    return means.join(total, BY).select("session_id", rounded("conditioned").alias("conditioned"), rounded("baseline").alias("baseline"),
                                        "rows", rounded("effect").alias("effect"), "paired", "paired_sessions").orderBy("session_id")


def _flag_spec() -> FeatureSpec:
    return FeatureSpec(minutes=240, lags=(1, 5), atr=5, vol_short=5, vol_long=5, extreme=5, momentum=5, warmup=5, horizons=(5,))


@query("flagship_session_effect", oracle.bars(240) + oracle.states(_flag_spec()) + ", hyp AS (" + stack_sql(MAIN) + ")" + MEANS_SQL +
       f""" SELECT session_id, {oracle.r('conditioned')} AS conditioned, {oracle.r('baseline')} AS baseline, n AS "rows", {oracle.r('CASE WHEN paired THEN pe ELSE uc - ub END')} AS effect,
  paired, paired_sessions FROM means JOIN summ USING (hypothesis)""")
def flagship_query(t: Tables) -> DataFrame:
    return flagship(t)


def _mask_query(name: str, specs):
    sql = QSQL + " " + " UNION ALL ".join(f"SELECT '{i}' AS hypothesis, count(*) FILTER ({condition_sql(c)}) AS selected, count(*) AS \"rows\" FROM states" for i, c in specs)

    @query(name, sql)
    def build(t: Tables) -> DataFrame:
        df = states(t)
        framed = C.with_thresholds(df, df, [c for _, c in specs])
        rows = E.stack_hypotheses(framed, [(i, C.condition(c), F.lit(1.0)) for i, c in specs], [])
        return rows.groupBy("hypothesis").agg(F.count_if("condition").alias("selected"), F.count(F.lit(1)).alias("rows"))
    return build


_mask_query("c01_minute_conditions", [("EQ60", {"type": "minute_equals", "field": "minute", "value": 60}), ("R0_90", {"type": "minute_range", "field": "minute", "start": 0, "end": 90})])
_mask_query("c02_quantile_conditions", [("GTE75", HIGH_VOL), ("LTE25", {"type": "quantile_lte", "field": "state_dist_low", "quantile": 0.25}), ("GTE90", {"type": "quantile_gte", "field": "state_momentum", "quantile": 0.9})])
_mask_query("c03_field_equals", [("UP", {"type": "field_equals", "field": "state_regime", "value": "TREND_UP"}), ("RANGE", {"type": "field_equals", "field": "state_regime", "value": "RANGE"})])
_mask_query("c04_conjunction", [("BOTH", CATALOGUE[-1][2]), ("TIME_VOL", {"type": "all", "clauses": [HIGH_VOL, {"type": "minute_range", "field": "minute", "start": 0, "end": 270}]})])
_mask_query("c05_session_hash", [("MOD10", {"type": "session_hash_mod", "modulus": 10, "remainder": 3}), ("MOD2", {"type": "session_hash_mod", "modulus": 2, "remainder": 0})])


@query("c06_train_learned_neighbours", QSQL + ", tr AS (SELECT * FROM states WHERE ts < TIMESTAMP '2024-01-16'), te AS (SELECT * FROM states WHERE ts >= TIMESTAMP '2024-01-16') " + " UNION ALL ".join(
    f"SELECT {n}::INT AS neighbour, count(*) FILTER (coalesce(state_vol_short >= (SELECT quantile_cont(state_vol_short, {C.clipped_quantile(0.75, n)}) FROM tr), false) AND minute BETWEEN {max(0, 30 + 15 * n)} AND {min(270, 240 + 15 * n)}) AS selected, "
    f"{oracle.r(f'(SELECT quantile_cont(state_vol_short, {C.clipped_quantile(0.75, n)}) FROM tr)')} AS threshold FROM te" for n in (-1, 0, 1)))
def train_learned(t: Tables) -> DataFrame:
    """Thresholds from the first half of the month, applied to the second half, with shifted neighbours."""
    df = states(t)
    cut = F.lit("2024-01-16").cast("timestamp")
    spec = {"type": "all", "clauses": [HIGH_VOL, {"type": "minute_range", "field": "minute", "start": 30, "end": 240}]}
    test = C.with_thresholds(df.where(F.col("ts") >= cut), df.where(F.col("ts") < cut), [spec], (-1, 0, 1))
    rows = [F.struct(F.lit(n).alias("neighbour"), C.condition(spec, n).alias("m"),
                     F.col(C.threshold_name("state_vol_short", C.clipped_quantile(0.75, n))).alias("q")) for n in (-1, 0, 1)]
    return test.select(F.inline(F.array(*rows))).groupBy("neighbour").agg(F.count_if("m").alias("selected"), rounded(F.max("q")).alias("threshold"))


SIGNALS = [{"id": "MOM_UP", "field": "state_return_5", "operator": "gte", "threshold": 0.5, "action": "LONG", "horizon": 5},
           {"id": "NEAR_LOW", "field": "state_dist_low", "operator": "lte", "threshold": 0.8, "action": "LONG", "horizon": 3},
           {"id": "MOM_DOWN", "field": "state_return_3", "operator": "lte", "threshold": -0.4, "action": "SHORT", "horizon": 5},
           {"id": "NEAR_HIGH", "field": "state_dist_high", "operator": "lte", "threshold": 1.0, "action": "SHORT", "horizon": 10}]


def signal_sql(s: dict, m: float = 1.0) -> str:
    return f"coalesce({s['field']} {'>=' if s['operator'] == 'gte' else '<='} {s['threshold']} * {m}, false)"


@query("c07_signal_masks", QSQL + " " + " UNION ALL ".join(f"SELECT '{s['id']}' AS signal, count(*) FILTER ({signal_sql(s)}) AS selected, count(*) FILTER ({signal_sql(s, C.magnitude_factor(s))}) AS stronger FROM states" for s in SIGNALS))
def signal_masks(t: Tables) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s["id"]).alias("signal"), C.signal(s).alias("a"), C.signal(s, C.magnitude_factor(s)).alias("b")) for s in SIGNALS])
    return states(t).select(F.inline(rows)).groupBy("signal").agg(F.count_if("a").alias("selected"), F.count_if("b").alias("stronger"))


def policy_sql(name: str, s: dict, train: str = "tr") -> str:
    q = lambda f, p: f"(SELECT quantile_cont({f}, {p}) FROM {train})"
    ratio = "state_spread_price / nullif(state_atr, 0)"
    return "coalesce(" + {
        "LOW_COST": f"state_spread_points <= {q('state_spread_points', 0.25)}",
        # A product of doubles, as in the query: with decimals 0.8 * 0.75 is one step less, and three fifths in doubles can lie above it.
        "HIGH_SIGNAL_MAGNITUDE": signal_sql({**s, "threshold": f"{s['threshold']}::DOUBLE"}, C.magnitude_factor(s)),
        "FAVORABLE_VOLATILITY": f"state_vol_short BETWEEN {q('state_vol_short', 0.25)} AND {q('state_vol_short', 0.75)}",
        "LOW_COST_ATR": f"{ratio} <= {q(ratio, 0.25)}",
        "SELECTED_TIME_WINDOW": "minute BETWEEN 60 AND 210",
        "RANGE_REGIME": "state_regime = 'RANGE'"}[name] + ", false)"


def with_cost_atr(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_atr", F.try_divide("state_spread_price", "state_atr"))


@query("c08_policy_filters", QSQL + f", tr AS (SELECT * FROM states WHERE ts < TIMESTAMP '2024-01-16' AND {signal_sql(SIGNALS[1])}), te AS (SELECT * FROM states WHERE ts >= TIMESTAMP '2024-01-16' AND {signal_sql(SIGNALS[1])}) " +
       " UNION ALL ".join(f"SELECT '{p}' AS policy, count(*) AS eligible, count(*) FILTER ({policy_sql(p, SIGNALS[1])}) AS entered FROM te" for p in C.POLICIES))
def policy_filters(t: Tables) -> DataFrame:
    """Eligible and entered rows of the second half per policy, thresholds from the first; a policy without such rows counts zero."""
    s = SIGNALS[1]
    rows = with_cost_atr(states(t)).where(C.signal(s))
    cut = F.lit("2024-01-16").cast("timestamp")
    test = C.with_thresholds(rows.where(F.col("ts") >= cut), rows.where(F.col("ts") < cut), [], extra=C.POLICY_NEEDS)
    # One aggregate without groups: it has its row where no row is eligible.
    counts = test.agg(F.count(F.lit(1)).alias("eligible"), *[F.count_if(C.policy(p, s)).alias(p) for p in C.POLICIES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(p).alias("policy"), F.col("eligible"), F.col(p).alias("entered")) for p in C.POLICIES])))


# ---- effects ---------------------------------------------------------------------------------------

@query("e01_session_means", evidence_sql(MAIN + UNPAIRED) + f" SELECT hypothesis, session_id, {oracle.r('conditioned')} AS conditioned, {oracle.r('baseline')} AS baseline, n AS \"rows\" FROM means")
def session_means(t: Tables) -> DataFrame:
    return rounded_all(E.session_means(stacked(t, MAIN + UNPAIRED), BY), ["conditioned", "baseline"])


@query("e02_effects", evidence_sql(MAIN + UNPAIRED) + f" SELECT hypothesis, {SUMMARY_COLS} FROM summ")
def effects(t: Tables) -> DataFrame:
    return rounded_summary(summary(t, MAIN + UNPAIRED))


@query("e02_influence", evidence_sql(MAIN + UNPAIRED) + f" SELECT hypothesis, session_id, side, {oracle.r('effect')} AS effect FROM eff")
def influence(t: Tables) -> DataFrame:
    return rounded_all(effect_sample(t, MAIN + UNPAIRED), ["effect"])


def effect_sample(t: Tables, specs) -> DataFrame:
    means = materialize(E.session_means(stacked(t, specs), BY))
    return E.influence(means, E.effect_summary(means, BY), BY)


@query("e03_support", QSQL + f", h AS (SELECT *, {condition_sql(HIGH_VOL)} AS c FROM states) SELECT 'VOL-Q75' AS hypothesis, count(*) AS condition_rows, count(DISTINCT session_id) AS condition_sessions, count(DISTINCT year(decision_ts)) AS condition_years, count(*) >= 500 AND count(DISTINCT session_id) >= 20 AND count(DISTINCT year(decision_ts)) >= 1 AS passed FROM h WHERE c")
def support(t: Tables) -> DataFrame:
    df = states(t)
    framed = C.with_thresholds(df, df, [HIGH_VOL]).withColumn("hypothesis", F.lit("VOL-Q75"))
    return E.support(framed, BY, C.condition(HIGH_VOL), F.year("decision_ts"), {"rows": 500, "sessions": 20, "years": 1})


FIXED = [("FIXED", "VOLATILITY", {"type": "fixed_gte", "field": "state_vol_short", "value": 1.5}, TARGET, 1),
         ("FIXED-RARE", "VOLATILITY", {"type": "fixed_gte", "field": "state_vol_short", "value": 60.0}, TARGET, 1)]


@query("e04_fixed_threshold_effect", QSQL + ", hyp AS (" + " UNION ALL ".join(
    f"SELECT '{s[0]}' AS hypothesis, session_id, coalesce(state_vol_short >= {s[2]['value']}, false) AS c, {TARGET} AS v FROM states WHERE {TARGET} IS NOT NULL" for s in FIXED) + ")" + MEANS_SQL +
    f" SELECT hypothesis, paired_sessions, {oracle.r('CASE WHEN paired_sessions >= 20 THEN pe END')} AS effect, CASE WHEN paired_sessions >= 20 THEN 'OK' ELSE 'INSUFFICIENT_PAIRED_SESSIONS' END AS status FROM summ WHERE paired_sessions > 0")
def fixed_effect(t: Tables) -> DataFrame:
    return rounded_all(E.require_pairs(E.paired_effects(E.session_means(stacked(t, FIXED), BY), BY), BY), ["effect"])


@query("e05_base_rates", evidence_sql(MAIN) + f" SELECT hypothesis, {oracle.r('avg(CASE WHEN c THEN v END)')} AS conditioned, {oracle.r('avg(CASE WHEN NOT c THEN v END)')} AS baseline, {oracle.r('avg(v)')} AS \"full\" FROM hyp GROUP BY hypothesis")
def base_rates(t: Tables) -> DataFrame:
    return rounded_all(E.base_rates(stacked(t, MAIN), BY), ["conditioned", "baseline", "full"])


def phi_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    k = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    erf = f"(1.0 - ((((1.061405429 * {k} - 1.453152027) * {k} + 1.421413741) * {k} - 0.284496736) * {k} + 0.254829592) * {k} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"


def p_sql(mean: str, se: str) -> str:
    return f"(CASE WHEN {mean} IS NULL OR {se} IS NULL OR {se} = 0 THEN CASE WHEN {mean} IS NULL OR {mean} <= 0 THEN 1.0 ELSE 0.0 END ELSE 1 - {phi_sql(f'({mean} / nullif({se}, 0))')} END)"


@query("e06_rate_lift", """WITH s AS (SELECT year(l_shipdate)::INT AS year, l_shipdate, l_quantity >= 25 AS sel, (l_returnflag = 'R')::INT AS hit FROM lineitem),
 p AS (SELECT year, l_shipdate, avg(CASE WHEN sel THEN hit END) - avg(hit) AS x FROM s GROUP BY year, l_shipdate),
 g AS (SELECT year, count(x) AS sessions, avg(x) AS lift, CASE WHEN count(x) >= 2 THEN stddev_samp(x) / sqrt(count(x)) END AS se FROM p GROUP BY year)
 SELECT year, sessions, """ + f"{oracle.r('lift')} AS lift, {oracle.r('se')} AS se, {oracle.r('lift - 1.96 * se')} AS ci_low, {oracle.r('lift + 1.96 * se')} AS ci_high, {oracle.r('CASE WHEN sessions < 2 THEN 1.0 ELSE ' + p_sql('lift', 'se') + ' END')} AS p_value FROM g")
def rate_lift(t: Tables) -> DataFrame:
    """Return rate of large line items against all, per ship date, by year."""
    rows = t.read("lineitem").withColumn("year", F.year("l_shipdate"))
    out = E.rate_lift(rows, ["year"], F.col("l_quantity") >= 25, F.col("l_returnflag") == "R", session="l_shipdate")
    return rounded_all(out, ["lift", "se", "ci_low", "ci_high", "p_value"])


@query("e07_clustered_mean", """WITH s AS (SELECT l_returnflag, l_shipdate, l_extendedprice * (l_discount - 0.05) AS v FROM lineitem), g AS (SELECT l_returnflag, avg(v) AS mean, count(*) AS "rows" FROM s GROUP BY 1),
 p AS (SELECT l_returnflag, l_shipdate, sum(v) AS sv, count(*) AS n FROM s GROUP BY 1, 2), i AS (SELECT l_returnflag, count(*) AS clusters, sum((sv - mean * n) * (sv - mean * n)) AS ss FROM p JOIN g USING (l_returnflag) GROUP BY 1),
 f AS (SELECT l_returnflag, "rows", clusters, mean, sqrt(ss * clusters / (clusters - 1)) / "rows" AS se FROM g JOIN i USING (l_returnflag))
 SELECT l_returnflag, "rows", clusters, """ + f"{oracle.r('mean', 4)} AS mean, {oracle.r('se', 4)} AS se, {oracle.r('mean - 1.96 * se', 4)} AS ci_low, {oracle.r('mean + 1.96 * se', 4)} AS ci_high, {oracle.r(p_sql('mean', 'se'), 4)} AS p_value FROM f")
def clustered(t: Tables) -> DataFrame:
    rows = t.read("lineitem").withColumn("v", F.col("l_extendedprice") * (F.col("l_discount") - 0.05))
    out = E.clustered_mean(rows, ["l_returnflag"], "v", session="l_shipdate")
    return rounded_all(out, ["mean", "se", "ci_low", "ci_high", "p_value"], 4)


@query("e08_one_sided_p", """WITH g AS (SELECT l_suppkey, avg(l_discount - 0.05) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(l_discount - 0.05) / sqrt(count(*)) END AS se, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n, """ +
       f"{oracle.r('mean')} AS mean, {oracle.r('se')} AS se, {oracle.r(p_sql('mean', 'se'))} AS p_value FROM g")
def one_sided(t: Tables) -> DataFrame:
    from barwright.functions.numeric import p_positive
    x = F.col("l_discount") - 0.05
    g = t.read("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
                                                  F.when(F.count(F.lit(1)) > 1, F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return g.select("l_suppkey", "n", rounded("mean").alias("mean"), rounded("se").alias("se"), rounded(p_positive("mean", "se")).alias("p_value"))


# ---- resampling ------------------------------------------------------------------------------------

def u_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || \':\' || '.join(parts)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def coin_sql(seed: str) -> str:
    """The sign of (resample r, position pos): one bit of a hash shared by 32 resamples."""
    parts = " || ':' || ".join([seed, "(r // 32)", "pos"])
    return f"CASE WHEN ((('0x' || substr(md5({parts}), 1, 8))::BIGINT >> (r % 32)::INT) & 1) = 1 THEN -1 ELSE 1 END"


def flips_sql(seed: str, count: int) -> str:
    """Means of all resamples of `placed`: 32 columns of one aggregate per hash, then rows."""
    coins = ", ".join(f"avg(CASE WHEN (h >> {bit}) & 1 = 1 THEN -effect ELSE effect END)" for bit in range(32))
    return f"""SELECT hypothesis, b * 32 + bit AS r, mean FROM (SELECT hypothesis, b, unnest([{coins}]) AS mean, unnest(range(32)) AS bit FROM (SELECT hypothesis, effect, b, ('0x' || substr(md5({seed} || ':' || b || ':' || pos), 1, 8))::BIGINT AS h
 FROM placed, (SELECT unnest(range({(count + 31) // 32})) AS b)) GROUP BY hypothesis, b) WHERE b * 32 + bit < {count}"""


def row_flips_sql(seed: str, count: int) -> str:
    """As `flips_sql` with all 128 bits of a hash: four words of 32 coins."""
    words = ", ".join(f"('0x' || substr(h, {1 + 8 * word}, 8))::BIGINT AS h{word}" for word in range(4))
    coins = ", ".join(f"avg(CASE WHEN (h{word} >> {bit}) & 1 = 1 THEN -effect ELSE effect END)" for word in range(4) for bit in range(32))
    return f"""SELECT hypothesis, b * 128 + bit AS r, mean FROM (SELECT hypothesis, b, unnest([{coins}]) AS mean, unnest(range(128)) AS bit FROM (SELECT hypothesis, effect, b, {words}
 FROM (SELECT hypothesis, effect, b, md5({seed} || ':' || b || ':' || pos) AS h FROM placed, (SELECT unnest(range({(count + 127) // 128})) AS b))) GROUP BY hypothesis, b) WHERE b * 128 + bit < {count}"""


PLACED = ", placed AS (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY session_id, side) - 1 AS pos, count(*) OVER (PARTITION BY hypothesis) AS n FROM eff)"
REP = f", reps AS (SELECT unnest(range({DRAWS})) AS r)"


def placed(t: Tables, specs=MAIN) -> DataFrame:
    return materialize(R.positions(effect_sample(t, specs), BY, ["session_id", "side"]))


def _boot(name: str, draw: str, build, extra: str = "", specs=MAIN):
    sql = evidence_sql(specs) + PLACED + REP + extra + f""", drawn AS ({draw}), dist AS (SELECT hypothesis, r AS resample, avg(p.effect) AS mean FROM drawn d JOIN placed p USING (hypothesis) WHERE p.pos = d.draw GROUP BY ALL)
SELECT hypothesis, resample, {oracle.r('mean')} AS mean FROM dist"""

    @query(name, sql)
    def run(t: Tables) -> DataFrame:
        return rounded_all(build(placed(t, specs)), ["mean"])
    return run


BLOCK = "least(20, greatest(2, floor(n / 5)))"
_boot("r01_session_bootstrap", f"SELECT hypothesis, r, floor({u_sql(chr(39) + 'S' + chr(39), 'r', 'pos')} * n)::BIGINT AS draw FROM placed, reps",
      lambda p: R.session_bootstrap(p, BY, DRAWS, F.lit("S")))
_boot("r02_block_bootstrap", f"SELECT hypothesis, r, floor({u_sql(chr(39) + 'B' + chr(39), 'r', '(pos // ' + BLOCK + '::BIGINT)')} * (n - {BLOCK} + 1))::BIGINT + pos % {BLOCK}::BIGINT AS draw FROM placed, reps",
      lambda p: R.block_bootstrap(p, BY, DRAWS, F.lit("B"), R.block_size(F.col("n"))))
_boot("r03_stationary_bootstrap", f"SELECT hypothesis, r, (floor({u_sql(chr(39) + 'T' + chr(39), chr(39) + 'draw' + chr(39), 'r', 'st')} * n)::BIGINT + pos - st) % n AS draw FROM segs",
      lambda p: R.stationary_bootstrap(p, BY, DRAWS, F.lit("T"), F.lit(float(MEAN_BLOCK))),
      f", segs AS (SELECT *, max(CASE WHEN pos = 0 OR {u_sql(chr(39) + 'T' + chr(39), chr(39) + 'restart' + chr(39), 'r', 'pos')} < {1 / MEAN_BLOCK} THEN pos END) OVER (PARTITION BY hypothesis, r ORDER BY pos) AS st FROM placed, reps)")


@query("r01_two_sample_bootstrap", evidence_sql(UNPAIRED) + REP + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY session_id) - 1 AS pos, count(*) OVER (PARTITION BY side) AS n FROM eff),
 drawn AS (SELECT side, r, floor({u_sql('side', 'r', 'pos')} * n)::BIGINT AS draw FROM placed, reps), m AS (SELECT side, r, avg(p.effect) AS mean FROM drawn d JOIN placed p USING (side) WHERE p.pos = d.draw GROUP BY ALL)
SELECT r AS resample, {oracle.r("max(CASE WHEN side = 'CONDITIONED' THEN mean END) - max(CASE WHEN side <> 'CONDITIONED' THEN mean END)")} AS mean FROM m GROUP BY r""")
def two_sample(t: Tables) -> DataFrame:
    p = materialize(R.positions(effect_sample(t, UNPAIRED), ["hypothesis", "side"], ["session_id"]))
    return R.two_sample_bootstrap(p, BY, DRAWS).select("resample", rounded("mean").alias("mean"))


@query("r04_bootstrap_summary", evidence_sql(MAIN) + PLACED + REP + f""", drawn AS (SELECT hypothesis, r, floor({u_sql("'S'", 'r', 'pos')} * n)::BIGINT AS draw FROM placed, reps),
 dist AS (SELECT hypothesis, r, avg(p.effect) AS mean FROM drawn d JOIN placed p USING (hypothesis) WHERE p.pos = d.draw GROUP BY ALL), o AS (SELECT hypothesis, avg(effect) AS obs FROM eff GROUP BY 1)
SELECT hypothesis, {oracle.r('max(obs)')} AS observed, {oracle.r('avg(mean)')} AS distribution_mean, {oracle.r('avg((sign(mean) = sign(obs))::INT)')} AS sign_stability, {oracle.r('avg((mean > 0)::INT)')} AS favourable, count(*) AS resamples,
 """ + ", ".join(f"{oracle.r(f'quantile_cont(mean, {q})')} AS {n}" for q, n in ((0.025, 'ci95_low'), (0.05, 'ci90_low'), (0.5, 'median'), (0.95, 'ci90_high'), (0.975, 'ci95_high'))) + " FROM dist JOIN o USING (hypothesis) GROUP BY hypothesis")
def boot_summary(t: Tables) -> DataFrame:
    p = placed(t)
    out = R.bootstrap_summary(R.session_bootstrap(p, BY, DRAWS, F.lit("S")), p.groupBy(*BY).agg(F.avg("effect").alias("observed")), BY)
    return rounded_all(out, [c for c in out.columns if c not in ("hypothesis", "resamples")])


def _tail_sql(null: str, obs: str = "avg(effect)", count: int = FLIPS) -> str:
    return f""", nulls AS ({null}), o AS (SELECT hypothesis, {obs} AS obs FROM placed GROUP BY 1)
SELECT hypothesis, {oracle.r('max(obs)')} AS observed, {oracle.r('quantile_cont(mean, 0.5)')} AS null_median, {oracle.r(f'(count(*) FILTER (mean >= obs - 1e-12) + 1) / {count + 1}.0')} AS p_value FROM nulls JOIN o USING (hypothesis) GROUP BY hypothesis"""


@query("r05_sign_flip", evidence_sql(MAIN) + PLACED + _tail_sql(flips_sql("'P'", FLIPS)))
def sign_flip(t: Tables) -> DataFrame:
    return rounded_all(R.sign_flip_test(placed(t), BY, FLIPS, F.lit("P")), ["observed", "null_median", "p_value"])


@query("r06_label_permutation", evidence_sql(UNPAIRED) + PLACED + f""", reps AS (SELECT unnest(range({FLIPS})) AS r), dealt AS (SELECT *, row_number() OVER (PARTITION BY hypothesis, r ORDER BY {u_sql(chr(39) + 'L' + chr(39), 'r', 'pos')}, pos) <= k AS f
  FROM (SELECT *, count(*) FILTER (side = 'CONDITIONED') OVER (PARTITION BY hypothesis) AS k FROM placed), reps)""" + _tail_sql("SELECT hypothesis, r, avg(CASE WHEN f THEN effect END) - avg(CASE WHEN NOT f THEN effect END) AS mean FROM dealt GROUP BY ALL",
                                                             "avg(CASE WHEN side = 'CONDITIONED' THEN effect END) - avg(CASE WHEN side <> 'CONDITIONED' THEN effect END)"))
def label_permutation(t: Tables) -> DataFrame:
    return rounded_all(R.label_permutation_test(placed(t, UNPAIRED), BY, FLIPS, F.lit("L")), ["observed", "null_median", "p_value"])


@query("r07_trade_sign_flip", """WITH placed AS (SELECT l_returnflag AS hypothesis, l_orderkey * 8 + l_linenumber AS pos, l_extendedprice * (l_discount - 0.05) AS effect FROM lineitem)""" +
       _tail_sql(row_flips_sql("'W'", FLIPS)).replace(", 6) + 0.0::DOUBLE AS observed", ", 3) + 0.0::DOUBLE AS observed").replace(", 6) + 0.0::DOUBLE AS null_median", ", 3) + 0.0::DOUBLE AS null_median"))
def trade_flip(t: Tables) -> DataFrame:
    """Sign flip over every trade: a matrix of coins per batch of rows, sums per resample out."""
    trades = t.read("lineitem").select(F.col("l_returnflag").alias("hypothesis"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
                                       (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("effect"))
    out = R.sign_flip_rows(trades, BY, FLIPS, "W")
    return out.select("hypothesis", rounded("observed", 3).alias("observed"), rounded("null_median", 3).alias("null_median"), rounded("p_value").alias("p_value"))


# ---- multiple testing --------------------------------------------------------------------------------

TESTS_SQL = """WITH g AS (SELECT l_suppkey, l_returnflag AS family, avg(l_discount - 0.05) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(l_discount - 0.05) / sqrt(count(*)) END AS se FROM lineitem GROUP BY ALL),
 tests AS (SELECT l_suppkey, family, round(""" + p_sql("mean", "se") + ", 9) AS p, (1 + l_suppkey % 3)::BIGINT AS planned FROM g), ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, l_suppkey) AS r, count(*) OVER (PARTITION BY family) AS n FROM tests)"


def tests(t: Tables) -> DataFrame:
    from barwright.functions.numeric import p_positive
    x = F.col("l_discount") - 0.05
    n = F.count(F.lit(1))
    g = t.read("lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("family")).agg(F.avg(x).alias("mean"), F.when(n > 1, F.stddev_samp(x) / F.sqrt(n)).alias("se"))
    return g.select("l_suppkey", "family", F.round(p_positive("mean", "se"), 9).alias("p"), (1 + F.pmod("l_suppkey", F.lit(3))).cast("bigint").alias("planned"))


@query("m01_benjamini_hochberg", TESTS_SQL + f" SELECT l_suppkey, family, {oracle.r('least(1.0, min(p * n / r) OVER (PARTITION BY family ORDER BY r DESC))')} AS q_value FROM ranked")
def bh(t: Tables) -> DataFrame:
    return R.adjusted_scan(tests(t), "p", ["family"], "l_suppkey", "BH", "q_value").select("l_suppkey", "family", rounded("q_value").alias("q_value"))


# A p-value has nine digits, so its Holm product is a whole number of billionths; halves are rounded up, whatever their binary neighbour.
HOLM_TAIL = " SELECT l_suppkey, family, ((least(1000000000, max(round(p * 1e9)::BIGINT * (n - r + 1)) OVER (PARTITION BY family ORDER BY r)) + 500) // 1000) / 1e6::DOUBLE AS holm_p FROM ranked"


def holm_rounded(tests: DataFrame, order: str = "l_suppkey") -> DataFrame:
    out = R.adjusted_scan(tests, "p", ["family"], order, "HOLM", "holm_p")
    return out.select(order, "family", rounded(F.round("holm_p", 9)).alias("holm_p"))


@query("m02_holm", TESTS_SQL + HOLM_TAIL)
def holm(t: Tables) -> DataFrame:
    return holm_rounded(tests(t))


@query("m03_planned_penalty", TESTS_SQL + f""", w AS (SELECT *, least(1.0, p * planned) AS wp FROM tests), x AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY wp, l_suppkey) AS r2, count(*) OVER (PARTITION BY family) AS n2 FROM w)
 SELECT l_suppkey, family, {oracle.r('wp')} AS within_p, {oracle.r('least(1.0, min(wp * n2 / r2) OVER (PARTITION BY family ORDER BY r2 DESC))')} AS adjusted_p FROM x""")
def planned(t: Tables) -> DataFrame:
    out = R.planned_scan(tests(t), "p", "planned", ["family"], "l_suppkey")
    return out.select("l_suppkey", "family", rounded("within_p").alias("within_p"), rounded("adjusted_p").alias("adjusted_p"))
