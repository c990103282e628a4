"""The discovery catalogue and its way from hypothesis to verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barwright.functions.numeric import rounded
from barwright.operators import conditions as C, effects as E, evidence as V, resampling as R, stability as S
from barwright.plans.bindings import Tables, rounded_all
from barwright.plans.evidence import BY, MEANS_SQL, SUMMARY_COLS, condition_sql, flips_sql, rounded_summary, u_sql
from barwright.plans.features import ESQL, experiences
from barwright.plans.oracle import r
from barwright.plans.registry import query
from barwright.plans.stability import SKEPTIC_SQL, reasons_sql
from barwright.session import materialize

DRAWS, FLIPS = 2000, 4000
# The catalogue of discovery (family, name, condition, target, action, direction, neighbours of the parameter). Targets of 15, 30
# and 60 minutes are horizons 3, 5 and 10 of quarter-hour bars.
DISCOVERY = [
    ("TEMPORAL", "MID_MORNING_VOL", {"type": "minute_range", "field": "minute", "start": 60, "end": 90}, "label_vol_5", "WAIT", "GREATER", (85, 95)),
    ("TEMPORAL", "LATE_SESSION_VOL", {"type": "minute_range", "field": "minute", "start": 180, "end": 210}, "label_vol_5", "WAIT", "GREATER", (205, 215)),
    ("VOLATILITY", "HIGH_VOL_SHORT_HORIZON", {"type": "quantile_gte", "field": "state_vol_short", "quantile": 0.80}, "label_vol_3", "WAIT", "GREATER", (0.75, 0.85)),
    ("VOLATILITY", "LOW_VOL_LONG_HORIZON", {"type": "quantile_lte", "field": "state_vol_long", "quantile": 0.20}, "label_vol_10", "WAIT", "LESS", (0.15, 0.25)),
    ("RANGE", "HIGH_RANGE_UP_EXCURSION", {"type": "quantile_gte", "field": "state_bar_range", "quantile": 0.80}, "label_up_5", "WAIT", "GREATER", (0.75, 0.85)),
    ("RANGE", "HIGH_RANGE_DOWN_EXCURSION", {"type": "quantile_gte", "field": "state_bar_range", "quantile": 0.80}, "label_down_5", "WAIT", "LESS", (0.75, 0.85)),
    ("MOMENTUM", "POSITIVE_MOMENTUM_LONG", {"type": "quantile_gte", "field": "state_return_3", "quantile": 0.80}, "net_5", "LONG", "GREATER", (0.75, 0.85)),
    ("MOMENTUM", "NEGATIVE_MOMENTUM_SHORT", {"type": "quantile_lte", "field": "state_return_3", "quantile": 0.20}, "net_5", "SHORT", "GREATER", (0.15, 0.25)),
    ("REVERSAL", "UP_MOVE_REVERSES", {"type": "quantile_gte", "field": "state_return_3", "quantile": 0.85}, "net_3", "SHORT", "GREATER", (0.80, 0.90)),
    ("REVERSAL", "DOWN_MOVE_REVERSES", {"type": "quantile_lte", "field": "state_return_3", "quantile": 0.15}, "net_3", "LONG", "GREATER", (0.10, 0.20)),
    ("CONTINUATION", "UP_CONTINUES", {"type": "quantile_gte", "field": "state_return_10", "quantile": 0.80}, "net_10", "LONG", "GREATER", (0.75, 0.85)),
    ("CONTINUATION", "DOWN_CONTINUES", {"type": "quantile_lte", "field": "state_return_10", "quantile": 0.20}, "net_10", "SHORT", "GREATER", (0.15, 0.25)),
    ("BREAKOUT", "NEAR_HIGH_BREAKS", {"type": "quantile_lte", "field": "state_dist_high", "quantile": 0.10}, "net_5", "LONG", "GREATER", (0.05, 0.15)),
    ("BREAKOUT", "NEAR_LOW_BREAKS", {"type": "quantile_lte", "field": "state_dist_low", "quantile": 0.10}, "net_5", "SHORT", "GREATER", (0.05, 0.15)),
    ("MEAN_REVERSION", "NEAR_HIGH_REVERTS", {"type": "quantile_lte", "field": "state_dist_high", "quantile": 0.10}, "net_5", "SHORT", "GREATER", (0.05, 0.15)),
    ("MEAN_REVERSION", "NEAR_LOW_REVERTS", {"type": "quantile_lte", "field": "state_dist_low", "quantile": 0.10}, "net_5", "LONG", "GREATER", (0.05, 0.15)),
    ("REGIME", "UP_REGIME_EXPANDS", {"type": "field_equals", "field": "state_regime", "value": "TREND_UP"}, "label_vol_5", "WAIT", "GREATER", ()),
    ("REGIME", "RANGE_REGIME_QUIET", {"type": "field_equals", "field": "state_regime", "value": "RANGE"}, "label_vol_5", "WAIT", "LESS", ()),
    ("COST", "LOW_SPREAD_LONG", {"type": "quantile_lte", "field": "state_spread_points", "quantile": 0.20}, "net_3", "LONG", "GREATER", (0.15, 0.25)),
    ("COST", "HIGH_SPREAD_LONG", {"type": "quantile_gte", "field": "state_spread_points", "quantile": 0.80}, "net_5", "LONG", "LESS", (0.75, 0.85)),
    ("CROSS_FEATURE", "LATE_HIGH_VOL", {"type": "all", "clauses": [{"type": "minute_range", "field": "minute", "start": 150, "end": 210}, {"type": "quantile_gte", "field": "state_vol_short", "quantile": 0.75}]}, "label_vol_5", "WAIT", "GREATER", ()),
    ("CROSS_FEATURE", "UP_REGIME_HIGH_RANGE", {"type": "all", "clauses": [{"type": "field_equals", "field": "state_regime", "value": "TREND_UP"}, {"type": "quantile_gte", "field": "state_bar_range", "quantile": 0.75}]}, "net_5", "LONG", "GREATER", ()),
    ("DATA_QUALITY", "HIGH_TICK_ACTIVITY", {"type": "quantile_gte", "field": "state_tick_volume", "quantile": 0.80}, "label_vol_5", "WAIT", "GREATER", (0.75, 0.85)),
    ("DATA_QUALITY", "LOW_TICK_ACTIVITY", {"type": "quantile_lte", "field": "state_tick_volume", "quantile": 0.20}, "label_vol_5", "WAIT", "LESS", (0.15, 0.25)),
]
# Least effect of a return and of other targets.
LEAST_RETURN, LEAST_OTHER = 0.00005, 0.00001
SUPPORT = {"rows": 5000, "sessions": 200, "years": 3}


# ---- the catalogue on quarter-hour experiences --------------------------------------------------------

W18 = ESQL + ", hyp AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS hypothesis, session_id, {condition_sql(condition, 'states')} AS c, {target} AS v FROM exps WHERE action = '{action}' AND {target} IS NOT NULL" for _, name, condition, target, action, *_ in DISCOVERY) + ")" + MEANS_SQL
TOLD = ", ".join(f"('{name}', '{family}', '{action}', '{direction}')" for family, name, _, _, action, direction, _ in DISCOVERY)


@query("w18_catalogue_effects", W18 + f" SELECT hypothesis, family, action, direction, CASE WHEN direction = 'GREATER' THEN pe_ > 0 ELSE pe_ < 0 END AS favourable, {SUMMARY_COLS} FROM (SELECT *, CASE WHEN paired THEN pe ELSE uc - ub END AS pe_ FROM summ) JOIN (VALUES {TOLD}) d(hypothesis, family, action, direction) USING (hypothesis)")
def catalogue(t: Tables) -> DataFrame:
    """All catalogue hypotheses with their actions and directions, from one scan and one shuffle on (hypothesis, session)."""
    df = experiences(t)
    # State columns are equal in the three experiences of a decision, so thresholds come from one of them.
    framed = C.with_thresholds(df, df.where("action = 'WAIT'"), [condition for _, _, condition, *_ in DISCOVERY])
    rows = E.stack_hypotheses(framed, [(name, C.condition(condition), F.when(F.col("action") == action, F.col(target))) for _, name, condition, target, action, *_ in DISCOVERY], ["session_id"])
    told = t.spark.createDataFrame([(name, family, action, direction) for family, name, _, _, action, direction, _ in DISCOVERY], "hypothesis string, family string, action string, direction string")
    out = E.effect_summary(E.session_means(rows, BY), BY).join(F.broadcast(told), BY)
    out = out.withColumn("favourable", F.when(F.col("direction") == "GREATER", F.col("effect") > 0).otherwise(F.col("effect") < 0))
    return rounded_summary(out)


# ---- verdicts on the seven years of line items --------------------------------------------------------

# A session is three days; outcomes depend on some states (cost on spread, reversal of moves, volatility that persists), not on others.
FIELDS = {
    "minute": "l_orderkey % 271", "state_vol_short": "l_extendedprice / 1e5 + l_quantity / 100", "state_vol_long": "l_extendedprice / 1e5", "state_bar_range": "l_tax * 10 + (l_partkey % 100) / 100.0::DOUBLE",
    "state_return_3": "(l_quantity - 25.5) / 25", "state_return_10": "(l_suppkey % 100 - 49.5) / 50", "state_dist_high": "1 - l_quantity / 50", "state_dist_low": "l_quantity / 50", "state_spread_points": "l_tax * 100",
    "state_tick_volume": "l_linenumber * 10.0::DOUBLE + l_partkey % 10", "label_vol_3": "l_extendedprice / 1e7 + abs(l_discount - 0.05) / 10", "label_vol_5": "l_quantity / 1e4 + abs(l_discount - 0.05) / 10",
    "label_vol_10": "l_extendedprice / 1e6 + abs(l_discount - 0.05)", "label_up_5": "l_discount + l_tax / 10", "label_down_5": "0 - l_discount - l_tax / 10"}
MOVE, COST = "(l_discount - 0.03) / 4 - 0.01 * (l_quantity - 25.5) / 25", "l_tax / 8"
HORIZON_FACTOR = {3: 1.0, 5: 1.5, 10: 2.0}
BOOK_SQL = "WITH book AS (SELECT (DATE '1970-01-01' + (date_diff('day', DATE '1970-01-01', l_shipdate::DATE) // 3 * 3)::INT)::VARCHAR AS session_id, l_extendedprice AS price, CASE l_returnflag WHEN 'R' THEN 'RANGE' WHEN 'A' THEN 'TREND_UP' ELSE 'TREND_DOWN' END AS state_regime, " + ", ".join(
    f"{expression} AS {name}" for name, expression in FIELDS.items()) + ", " + ", ".join(f"{'-' if a == 'SHORT' else ''}({MOVE}) * {k} AS gross_{a.lower()}_{h}, {COST} AS cost_{a.lower()}_{h}, {'-' if a == 'SHORT' else ''}({MOVE}) * {k} - {COST} AS net_{a.lower()}_{h}"
                                                                         for a in ("LONG", "SHORT") for h, k in HORIZON_FACTOR.items()) + " FROM lineitem)"
CUT = "1999-01-01"


def specs() -> list[dict]:
    out = []
    for family, name, condition, target, action, direction, neighbours in DISCOVERY:
        traded = target.startswith("net_")
        column = f"net_{action.lower()}_{target[4:]}" if traded else target
        out.append({"id": name, "family": family, "condition": condition, "target": column, "action": action, "direction": direction, "neighbours": neighbours,
                    "minimum_effect": LEAST_RETURN if traded else LEAST_OTHER, "gross": column.replace("net", "gross") if traded else None, "cost": column.replace("net", "cost") if traded else None})
    return out


SPECS = specs()
TARGETS = sorted({s["target"] for s in SPECS})


def book(t: Tables) -> DataFrame:
    """Line items as decisions: states, labels, and outcomes of both actions at three horizons."""
    day = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date"))
    session = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(day / 3) * 3).cast("int")), "yyyy-MM-dd")
    regime = F.when(F.col("l_returnflag") == "R", "RANGE").when(F.col("l_returnflag") == "A", "TREND_UP").otherwise("TREND_DOWN")
    plain = {name: F.expr(expression.replace("::DOUBLE", "D")) for name, expression in FIELDS.items()}
    move, cost = F.expr(MOVE), F.expr(COST)
    sided = {f"{kind}_{a.lower()}_{h}": value for a, s in (("LONG", 1), ("SHORT", -1)) for h, k in HORIZON_FACTOR.items() for kind, value in (("gross", s * move * k), ("cost", cost), ("net", s * move * k - cost))}
    return t.read("lineitem").select(session.alias("session_id"), F.col("l_extendedprice").alias("price"), regime.alias("state_regime"), *[value.alias(name) for name, value in (plain | sided).items()])


def judged(t: Tables, part: str, chosen: list[dict]) -> DataFrame:
    """Facts of the chosen hypotheses on one part; thresholds are always those of the development part."""
    rows = book(t)
    dev = rows.where(F.col("session_id") < CUT)
    own = dev if part == "DEV" else rows.where(F.col("session_id") >= CUT)
    targets = sorted({s["target"] for s in chosen})
    # One row of numbers, learned once for both parts.
    limits = t.stored("verdict_limits", lambda: C.learn_thresholds(dev, V.quantiles_needed(SPECS))).first().asDict()
    table = V.sums(V.late_outcomes(own, targets, ["minute"]), chosen, limits=limits)
    year = F.substring("session_id", 1, 4)
    half = F.concat(year, F.when(F.substring("session_id", 6, 2) <= "06", F.lit("-H1")).otherwise(F.lit("-H2")))
    blocking = own.agg((F.count_if(F.col("price") <= 0) > 0).alias("blocking"))
    return V.facts(table, chosen, [year, half], year, blocking, DRAWS, FLIPS)


def evidence(t: Tables) -> DataFrame:
    """Scores, reasons and verdicts of the catalogue on the development part."""
    def build() -> DataFrame:
        rows = judged(t, "DEV", SPECS)
        passed = (F.col("condition_rows") >= SUPPORT["rows"]) & (F.col("condition_sessions") >= SUPPORT["sessions"]) & (F.col("condition_years") >= SUPPORT["years"])
        rows = rows.withColumns({"support_passed": passed, "p_rounded": F.round("p_value", 9), "_all": F.lit(1)})
        rows = R.planned_penalty(rows, "p_rounded", "planned", ["_all"], "hypothesis")
        return S.evidence_score(rows, F.col("minimum_effect")).drop("_all")
    return t.stored("verdict_evidence", build)


FACT_COLUMNS = ("effect", "sessions", "temporal_favourable", "cost_favourable", "parameter_favourable", "bootstrap_favourable", "adjusted_p", "skeptic_survival", "late_effect", "random_effect", "score")


def _near_sql(condition: dict, value: float) -> str:
    return condition_sql({**condition, "end" if condition["type"] == "minute_range" else "quantile": value}, "dev")


def _hypothesis_sql(s: dict) -> str:
    minus = "" if s["direction"] == "GREATER" else "-"
    near = [_near_sql(s["condition"], value) for value in s["neighbours"]] + ["NULL::BOOLEAN"] * 2
    money = f"{minus}{s['gross']}, {minus}{s['cost']}" if s["gross"] else "NULL::DOUBLE, NULL::DOUBLE"
    return f"SELECT '{s['id']}', session_id, {condition_sql(s['condition'], 'dev')}, {near[0]}, {near[1]}, {condition_sql(V.RANDOM)}, {minus}{s['target']}, {minus}late_{s['target']}, {money} FROM fr"


def _pair_sql(mask: str, value: str, name: str) -> str:
    return f"avg(CASE WHEN {mask} THEN {value} END) AS {name}1, avg(CASE WHEN NOT {mask} THEN {value} END) AS {name}0"


def _chain_sql(source: str, restrict: str = "") -> str:
    """From rows of `source` to one row of facts per hypothesis (`fin`). All hypotheses of the catalogue pair by session."""
    named = [("MAIN", "v"), ("NEIGHBOUR_a", "a"), ("NEIGHBOUR_b", "b"), ("RANDOM", "r"), ("LATE", "w"), *[(f"COST_{m}", f"k{i}_") for i, m in enumerate(V.MULTIPLIERS)]]
    variants = [f"SELECT hypothesis, '{name}' AS variant, session_id, {c}1 AS a, {c}0 AS b FROM ps" for name, c in named]
    variants += [f"SELECT hypothesis, 'PERIOD_' || substr(session_id, 1, 4){half}, session_id, v1, v0 FROM ps" for half in ("", " || CASE WHEN substr(session_id, 6, 2) <= '06' THEN '-H1' ELSE '-H2' END")]
    good = " + ".join(f"coalesce({c} > 0, false)::INT" for c in ("winsorised", "drop_best", "drop_worst"))
    told = ", ".join(f"('{s['id']}', '{s['action']}', '{s['direction']}', {s['minimum_effect']}::DOUBLE, {1 + len(s['neighbours'])})" for s in SPECS)
    slots = ", ".join(f"avg({x}) AS {x}" for x in TARGETS)
    lags = ", ".join(f"lag({x}, {V.LATE}) OVER (PARTITION BY minute ORDER BY session_id) AS late_{x}" for x in TARGETS)
    return f""", late AS (SELECT minute, session_id, {lags} FROM (SELECT minute, session_id, {slots} FROM {source} GROUP BY ALL)), fr AS MATERIALIZED (SELECT * FROM {source} JOIN late USING (minute, session_id)),
 hyp(hypothesis, session_id, m, a, b, r, v, w, g, c) AS ({" UNION ALL ".join(map(_hypothesis_sql, SPECS))}),
 ps AS MATERIALIZED (SELECT hypothesis, session_id, count(*) FILTER (m) AS k, {_pair_sql('m', 'v', 'v')}, {_pair_sql('a', 'v', 'a')}, {_pair_sql('b', 'v', 'b')}, {_pair_sql('r', 'v', 'r')}, {_pair_sql('m', 'w', 'w')},
  {", ".join(_pair_sql('m', f'(g - {m} * c)', f'k{i}_') for i, m in enumerate(V.MULTIPLIERS))}, sum(CASE WHEN m THEN v END) AS total, count(CASE WHEN m THEN v END) AS number, count(g) AS traded FROM hyp {restrict} GROUP BY ALL),
 va AS ({" UNION ALL ".join(variants)}),
 ge AS MATERIALIZED (SELECT hypothesis, variant, count(a - b) AS sessions, CASE WHEN count(a - b) >= greatest(20, floor(0.25 * count(*))) THEN avg(a - b) ELSE avg(a) - avg(b) END AS effect FROM va WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY ALL),
 sh AS (SELECT hypothesis, max(CASE variant WHEN 'MAIN' THEN effect END) AS effect, max(CASE variant WHEN 'MAIN' THEN sessions END) AS sessions, max(CASE variant WHEN 'RANDOM' THEN effect END) AS random_effect, max(CASE variant WHEN 'LATE' THEN effect END) AS late_effect,
  max(CASE variant WHEN 'COST_2.0' THEN effect END) AS cost_2x, avg(CASE WHEN variant LIKE 'PERIOD%' AND effect IS NOT NULL THEN (effect > 0)::INT END) AS temporal_favourable, coalesce(avg(CASE WHEN variant LIKE 'COST%' AND effect IS NOT NULL THEN (effect > 0)::INT END), 1) AS cost_favourable,
  avg(CASE WHEN variant IN ('MAIN', 'NEIGHBOUR_a', 'NEIGHBOUR_b') AND effect IS NOT NULL THEN (effect > 0)::INT END) AS parameter_favourable,
  coalesce(max(CASE WHEN len(variant) = 11 AND variant LIKE 'PERIOD%' THEN abs(effect) END) / nullif(sum(CASE WHEN len(variant) = 11 AND variant LIKE 'PERIOD%' THEN abs(effect) END), 0), 1) AS year_concentration FROM ge GROUP BY hypothesis),
 su AS (SELECT hypothesis, sum(k)::BIGINT AS condition_rows, count(*) FILTER (k > 0) AS condition_sessions, count(DISTINCT CASE WHEN k > 0 THEN substr(session_id, 1, 4) END) AS condition_years, sum(total) / nullif(sum(number), 0) AS conditioned_mean, sum(traded) > 0 AS tradable FROM ps GROUP BY hypothesis),
 eff AS MATERIALIZED (SELECT hypothesis, session_id, a - b AS effect FROM va WHERE variant = 'MAIN' AND a - b IS NOT NULL),
 placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY session_id) - 1 AS pos, count(*) OVER (PARTITION BY hypothesis) AS n FROM eff),
 draws AS MATERIALIZED (SELECT r, pos, {u_sql("'S'", "'PAIR'", 'r', 'pos')} AS u FROM (SELECT unnest(range({DRAWS})) AS r), (SELECT unnest(range((SELECT max(n) FROM placed))) AS pos)),
 lists AS (SELECT hypothesis, count(*) AS n, list(effect ORDER BY session_id) AS e FROM eff GROUP BY 1), boot AS (SELECT hypothesis, r, avg(e[1 + floor(u * n)::BIGINT]) AS mean FROM lists JOIN draws ON pos < n GROUP BY ALL),
 bs AS (SELECT hypothesis, avg((mean > 0)::INT) AS bootstrap_favourable, avg((sign(mean) = sign(effect))::INT) AS sign_stability, quantile_cont(mean, 0.025) AS ci95_low FROM boot JOIN sh USING (hypothesis) GROUP BY 1),
 nulls AS ({flips_sql("'S'", FLIPS)}), pv AS (SELECT hypothesis, round((count(*) FILTER (mean >= effect - 1e-12) + 1) / {FLIPS + 1}.0::DOUBLE, 9) AS p FROM nulls JOIN sh USING (hypothesis) GROUP BY hypothesis){SKEPTIC_SQL},
 bl AS (SELECT count(*) FILTER (price <= 0) > 0 AS blocking FROM {source}), d(hypothesis, action, direction, minimum_effect, planned) AS (VALUES {told}),
 fin AS MATERIALIZED (SELECT *, ({good} + (outlier_share <= 0.5)::INT + (temporal_favourable >= 0.6)::INT + CASE WHEN tradable THEN (cost_2x > 0)::INT ELSE 0 END + (NOT blocking)::INT + 1) / (7 + tradable::INT)::DOUBLE AS skeptic_survival,
  coalesce(abs(late_effect) <= 0.5 * greatest(abs(effect), 1e-12), false) AS slow_passed, coalesce(abs(late_effect) <= 0.5 * greatest(abs(effect), 1e-12), false) AND coalesce(abs(random_effect) <= 0.5 * greatest(abs(effect), 1e-12), false) AS controls_passed
  FROM d JOIN sh USING (hypothesis) JOIN su USING (hypothesis) JOIN bs USING (hypothesis) JOIN pv USING (hypothesis) JOIN sk USING (hypothesis), bl)"""


REASONS = reasons_sql([("effect_direction_failed", "effect > 0"), ("economic_materiality_failed", "abs(effect) >= minimum_effect"), ("multiple_testing_failed", "adjusted_p <= 0.05"), ("temporal_stability_failed", "temporal_favourable >= 0.6"),
                       ("parameter_stability_failed", "parameter_favourable >= 0.6"), ("negative_control_failed", "controls_passed"),
                       ("minimum_support_failed", f"condition_rows >= {SUPPORT['rows']} AND condition_sessions >= {SUPPORT['sessions']} AND condition_years >= {SUPPORT['years']}")])
T17 = BOOK_SQL + f", dev AS MATERIALIZED (SELECT * FROM book WHERE session_id < '{CUT}')" + _chain_sql("dev") + f""",
 wi AS (SELECT *, least(1.0, p * planned) AS wp FROM fin), rk AS (SELECT *, row_number() OVER (ORDER BY wp, hypothesis) AS place, count(*) OVER () AS number FROM wi), ad AS (SELECT *, least(1.0, min(wp * number / place) OVER (ORDER BY place DESC)) AS adjusted_p FROM rk),
 sc AS (SELECT *, 0.1 * least(1.0, abs(effect) / minimum_effect) + 0.15 * bootstrap_favourable + 0.15 * temporal_favourable + 0.1 * cost_favourable + 0.15 * (1 - adjusted_p) + 0.05 * least(1.0, sessions / 200) + 0.1 * (NOT blocking)::INT + 0.1 * parameter_favourable + 0.1 * controls_passed::INT AS score, {REASONS} AS reasons FROM ad),
 t17 AS (SELECT *, CASE WHEN len(reasons) = 0 AND bootstrap_favourable >= 0.9 AND skeptic_survival >= 0.65 AND sessions >= 50 THEN 'DEV_SURVIVOR' ELSE 'REJECTED' END AS verdict FROM sc)"""
GATES = reasons_sql([("same_direction", "effect > 0"), ("ci95_directional", "ci95_low > 0"), ("holm", "holm_p <= 0.05"), ("bootstrap_favourable", "bootstrap_favourable >= 0.90"), ("sign_stability", "sign_stability >= 0.90"),
                     ("support", "condition_rows >= 5000 AND condition_sessions >= 200 AND condition_years >= 3"), ("temporal", "temporal_favourable >= 0.6"), ("not_year_concentrated", "year_concentration <= 0.6"), ("skeptic", "skeptic_survival >= 0.75"), ("slow_structure", "slow_passed")])
T18 = (f"WITH ready AS MATERIALIZED (SELECT hypothesis FROM ({T17} SELECT hypothesis, verdict, score FROM t17) WHERE verdict = 'DEV_SURVIVOR' AND score >= 0.75), " + BOOK_SQL.removeprefix("WITH ")
       + f", dev AS MATERIALIZED (SELECT * FROM book WHERE session_id < '{CUT}'), val AS MATERIALIZED (SELECT * FROM book WHERE session_id >= '{CUT}')" + _chain_sql("val", "WHERE hypothesis IN (SELECT hypothesis FROM ready)") + f""",
 rk AS (SELECT *, row_number() OVER (ORDER BY p, hypothesis) AS place, count(*) OVER () AS number, CASE WHEN tradable THEN CASE direction WHEN 'GREATER' THEN conditioned_mean ELSE -conditioned_mean END END AS net_return FROM fin),
 hm AS (SELECT *, least(1.0, max(p * (number - place + 1)) OVER (ORDER BY place)) AS holm_p FROM rk), gt AS (SELECT *, {GATES} AS failed FROM hm)""")


@query("t17_evidence_score", T17 + f" SELECT hypothesis, direction, action, condition_rows, condition_sessions, condition_years, {', '.join(f'{r(c)} AS {c}' for c in FACT_COLUMNS)}, controls_passed, array_to_string(reasons, ',') AS rejection_reasons, verdict FROM t17")
def evidence_score(t: Tables) -> DataFrame:
    """Every input computed: effect, bootstrap, permutation with FDR, periods, costs, neighbours, controls and skeptic of each hypothesis."""
    out = evidence(t)
    return out.select("hypothesis", "direction", "action", "condition_rows", "condition_sessions", "condition_years", *[rounded(c).alias(c) for c in FACT_COLUMNS], "controls_passed",
                      F.concat_ws(",", "rejection_reasons").alias("rejection_reasons"), "verdict")


@query("t18_confirmation_verdict", T18 + f""" SELECT hypothesis, direction, {', '.join(f'{r(c)} AS {c}' for c in ('effect', 'ci95_low', 'holm_p'))}, {r('bootstrap_favourable')} AS favourable, {', '.join(f'{r(c)} AS {c}' for c in ('sign_stability', 'temporal_favourable', 'year_concentration', 'skeptic_survival', 'net_return'))},
 array_to_string(failed, ',') AS failed_checks, CASE WHEN len(failed) > 0 THEN 'VALIDATION_FAILED' WHEN net_return > 0 THEN 'VALIDATED_ECONOMIC_CANDIDATE' ELSE 'VALIDATED_PREDICTIVE_RELATIONSHIP_NO_TRADE' END AS verdict FROM gt""")
def confirmation(t: Tables) -> DataFrame:
    """Survivors of development with a score of 0.75 or more, judged once on the later years with frozen thresholds."""
    ready = {row["hypothesis"] for row in evidence(t).where("verdict = 'DEV_SURVIVOR' AND score >= 0.75").select("hypothesis").collect()}
    chosen = [s for s in SPECS if s["id"] in ready]
    if not chosen:
        return t.spark.createDataFrame([], CONFIRMED)
    rows = materialize(judged(t, "VALIDATION", chosen)).withColumns({"p_rounded": F.round("p_value", 9), "_all": F.lit(1)})
    rows = R.holm(rows, "p_rounded", ["_all"], "hypothesis").withColumns({"favourable": F.col("bootstrap_favourable"), "net_return": F.when(F.col("tradable"), F.when(F.col("direction") == "GREATER", 1).otherwise(-1) * F.col("conditioned_mean"))})
    out = S.confirmation_verdict(rows)
    return out.select("hypothesis", "direction", *[rounded(c).alias(c) for c in ("effect", "ci95_low", "holm_p", "favourable", "sign_stability", "temporal_favourable", "year_concentration", "skeptic_survival", "net_return")],
                      F.concat_ws(",", "failed_checks").alias("failed_checks"), "verdict")


CONFIRMED = ("hypothesis string, direction string, effect double, ci95_low double, holm_p double, favourable double, sign_stability double, temporal_favourable double, year_concentration double, skeptic_survival double, "
             "net_return double, failed_checks string, verdict string")


@query("w17_discovery_consolidation", T17 + f""", f17 AS (SELECT *, CASE WHEN verdict = 'DEV_SURVIVOR' AND score >= 0.75 THEN 'VALIDATION_READY' ELSE verdict END AS status, CASE direction WHEN 'GREATER' THEN conditioned_mean ELSE -conditioned_mean END AS level
  FROM t17 JOIN (VALUES {', '.join(f"('{s['id']}', '{s['family']}')" for s in SPECS)}) fa(hypothesis, family) USING (hypothesis))
 SELECT family, count(*) AS hypotheses, count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (status = 'VALIDATION_READY') AS ready, CASE WHEN count(*) FILTER (status = 'REJECTED') = count(*) THEN 'NO_PREDICTIVE_INFORMATION_IN_TESTED_REGION' ELSE 'DEV_STATISTICAL_CANDIDATE_NOT_VALIDATED' END AS conclusion,
  coalesce(string_agg(CASE WHEN status = 'REJECTED' THEN hypothesis || ': ' || array_to_string(reasons, ',') END, '; ' ORDER BY hypothesis), '') AS known, coalesce(string_agg(CASE WHEN status = 'VALIDATION_READY' AND tradable AND level <= 0 THEN hypothesis END, ',' ORDER BY hypothesis), '') AS no_trade FROM f17 GROUP BY family""")
def discovery_consolidation(t: Tables) -> DataFrame:
    """What discovery leaves per family: totals, the rejected with their reasons, and survivors whose conditioned return is not positive."""
    status = F.when((F.col("verdict") == "DEV_SURVIVOR") & (F.col("score") >= 0.75), F.lit("VALIDATION_READY")).otherwise(F.col("verdict"))
    level = F.when(F.col("direction") == "GREATER", F.col("conditioned_mean")).otherwise(-F.col("conditioned_mean"))
    rows = evidence(t).withColumn("status", status)
    rejected, ready = F.col("status") == "REJECTED", F.col("status") == "VALIDATION_READY"

    def listed(on, text, between: str):
        return F.concat_ws(between, F.sort_array(F.collect_list(F.when(on, text))))
    # A family is a handful of hypotheses.
    return rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("hypotheses"), F.count_if(rejected).alias("rejected"), F.count_if(ready).alias("ready"),
        F.when(F.count_if(rejected) == F.count(F.lit(1)), F.lit("NO_PREDICTIVE_INFORMATION_IN_TESTED_REGION")).otherwise(F.lit("DEV_STATISTICAL_CANDIDATE_NOT_VALIDATED")).alias("conclusion"),
        listed(rejected, F.concat("hypothesis", F.lit(": "), F.concat_ws(",", "rejection_reasons")), "; ").alias("known"), listed(ready & F.col("tradable") & (level <= 0), F.col("hypothesis"), ",").alias("no_trade"))
