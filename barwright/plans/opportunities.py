"""The large-move campaign: thirty registered hypotheses with own horizon and multiple of the cost, on line items as a trade ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.hashing import uniform
from barwright.functions.numeric import failed_names, interval95, p_positive, ratio, rounded
from barwright.operators import conditions as C, effects as E, resampling as R, stability as S, walkforward as W
from barwright.operators.quantiles import column_quantiles
from barwright.operators.tallies import tallies
from barwright.plans.bindings import Tables, rounded_all
from barwright.plans.campaigns import EMBARGO, FIRST, PURGE, folds_sql
from barwright.plans.evidence import p_sql
from barwright.plans.oracle import r
from barwright.plans.registry import query
from barwright.plans.stability import attack_sql, reasons_sql
from barwright.session import materialize


def _q(kind: str, field: str, q: float) -> dict:
    return {"type": f"quantile_{kind}", "field": field, "quantile": q}


def _both(*clauses: dict) -> dict:
    return {"type": "all", "clauses": list(clauses)}


def _minute(start: int, end: int) -> dict:
    return {"type": "minute_range", "field": "minute", "start": start, "end": end}


# The registry (family, horizon in minutes, multiple K of the cost, condition), in the order of its numbers.
REGISTRY = [
    ("VOLATILITY_EXPANSION", 15, 2, _q("gte", "volatility_15", 0.75)), ("VOLATILITY_EXPANSION", 30, 3, _q("gte", "volatility_60", 0.75)), ("VOLATILITY_EXPANSION", 60, 3, _q("gte", "atr", 0.75)),
    ("RANGE_BREAK", 30, 2, _q("lte", "distance_high", 0.1)), ("RANGE_BREAK", 30, 2, _q("lte", "distance_low", 0.1)), ("RANGE_BREAK", 30, 3, _q("lte", "distance_extreme", 0.1)),
    ("POST_COMPRESSION_EXPANSION", 30, 2, _q("lte", "volatility_15", 0.25)), ("POST_COMPRESSION_EXPANSION", 60, 3, _q("lte", "volatility_60", 0.25)), ("POST_COMPRESSION_EXPANSION", 15, 2, _q("lte", "bar_range", 0.25)),
    ("SESSION_TRANSITION", 30, 3, _minute(0, 30)), ("SESSION_TRANSITION", 30, 2, _minute(90, 120)), ("SESSION_TRANSITION", 60, 3, _minute(210, 270)),
    ("EXTREME_EXCURSION", 30, 3, _q("gte", "abs_return_15", 0.9)), ("EXTREME_EXCURSION", 15, 2, _q("gte", "abs_return_5", 0.9)), ("EXTREME_EXCURSION", 30, 3, _q("lte", "distance_extreme", 0.05)),
    ("MOMENTUM_BURST", 30, 3, _q("gte", "abs_momentum", 0.8)), ("MOMENTUM_BURST", 30, 2, _q("gte", "momentum", 0.8)), ("MOMENTUM_BURST", 30, 2, _q("lte", "momentum", 0.2)),
    ("BREAKOUT_CONTINUATION", 30, 3, _both(_q("lte", "distance_high", 0.1), _q("gte", "momentum", 0.7))), ("BREAKOUT_CONTINUATION", 30, 3, _both(_q("lte", "distance_low", 0.1), _q("lte", "momentum", 0.3))),
    ("BREAKOUT_CONTINUATION", 60, 3, _both(_q("gte", "bar_range", 0.75), _q("gte", "abs_momentum", 0.75))),
    ("FAILED_BREAKOUT", 15, 2, _both(_q("lte", "distance_high", 0.1), _q("lte", "return_1", 0.25))), ("FAILED_BREAKOUT", 15, 2, _both(_q("lte", "distance_low", 0.1), _q("gte", "return_1", 0.75))),
    ("FAILED_BREAKOUT", 30, 3, _both(_q("lte", "distance_extreme", 0.1), _q("gte", "abs_return_1", 0.75))),
    ("LIQUIDITY_SWEEP_PROXY", 15, 3, _both(_q("gte", "bar_range", 0.8), _q("lte", "distance_extreme", 0.1))), ("LIQUIDITY_SWEEP_PROXY", 30, 3, _both(_q("gte", "tick_volume", 0.8), _q("lte", "distance_extreme", 0.1))),
    ("LIQUIDITY_SWEEP_PROXY", 15, 3, _both(_q("gte", "spread_points", 0.8), _q("gte", "bar_range", 0.8))),
    ("VOLATILITY_REGIME_TRANSITION", 30, 3, _q("gte", "vol_ratio", 0.8)), ("VOLATILITY_REGIME_TRANSITION", 60, 3, _q("gte", "atr_range_ratio", 0.8)),
    ("VOLATILITY_REGIME_TRANSITION", 30, 3, _both(_q("gte", "tick_volume", 0.8), _q("gte", "volatility_15", 0.8))),
]
IDS = [f"OPP-{i + 1:02d}" for i in range(len(REGISTRY))]
# Least support of a hypothesis, and the share of an excursion that each horizon sees.
LEAST_ROWS, LEAST_SESSIONS, LEAST_YEARS = 500, 100, 3
REACH = {5: 0.5, 15: 0.8, 30: 1.0, 60: 1.25}
COMBOS = sorted({(h, k) for _, h, k, _ in REGISTRY})

# Line items as decisions. Moves are large where spreads are narrow, volatility is high or both prices lie far apart; other states say nothing.
STATES = {"minute": "l_orderkey % 271", "volatility_15": "l_extendedprice / 1e5 + l_quantity / 100", "volatility_60": "l_extendedprice / 1e5 + (l_suppkey % 100) / 1000.0D", "atr": "l_extendedprice / 1e5", "distance_high": "1 - l_quantity / 50",
          "distance_low": "l_quantity / 50", "distance_extreme": "least(1 - l_quantity / 50, l_quantity / 50)", "bar_range": "l_tax * 10 + (l_partkey % 100) / 100.0D", "return_1": "(l_suppkey % 100 - 49.5D) / 50", "abs_return_1": "abs((l_suppkey % 100 - 49.5D) / 50)",
          "abs_return_5": "abs((l_partkey % 100 - 49.5D) / 50)", "abs_return_15": "abs((l_quantity - 25.5D) / 25)", "momentum": "(l_quantity - 25.5D) / 25 + (l_suppkey % 100 - 49.5D) / 50", "abs_momentum": "abs((l_quantity - 25.5D) / 25 + (l_suppkey % 100 - 49.5D) / 50)",
          "tick_volume": "l_linenumber * 10.0D + l_partkey % 10", "spread_points": "l_tax * 100", "vol_ratio": "(l_extendedprice / 1e5 + l_quantity / 100) / (l_extendedprice / 1e5 + (l_suppkey % 100) / 1000.0D)",
          "atr_range_ratio": "l_extendedprice / 1e5 / nullif(l_tax * 10 + (l_partkey % 100) / 100.0D, 0)"}
OUTCOMES = {"up": "l_discount * (0.6D + l_extendedprice / 2e5)", "down": "l_tax - 0.08D", "cost": "0.004D + l_tax / 4", "g": "l_discount - 0.03D + (l_quantity - 25.5D) / 1000"}


def ledger(t: Tables) -> DataFrame:
    regime = F.when(F.col("l_returnflag") == "R", "RANGE").when(F.col("l_returnflag") == "A", "TREND_UP").otherwise("TREND_DOWN")
    return t.read("lineitem").select(F.col("l_shipdate").alias("ts"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("session_id"), regime.alias("state_regime"), uniform(F.lit("rand"), F.col("l_orderkey"), F.col("l_linenumber")).alias("coin"),
                                     *[F.expr(x).alias(name) for name, x in (STATES | OUTCOMES).items()])


def test_rows(t: Tables) -> DataFrame:
    """Test rows with three bit sets: the hypotheses that choose the row (thresholds of its own fold), and those whose weaker and stronger
    neighbours do (thresholds of the last fold's training rows). A row is one row, however many hypotheses there are."""
    def build() -> DataFrame:
        roled = W.fold_roles(ledger(t), "ts", FIRST, PURGE, EMBARGO)
        conditions = [condition for *_, condition in REGISTRY]
        learned = C.learn_thresholds(roled, set().union(*[C.quantile_needs(c, n) for c in conditions for n in (-1, 0, 1)]), fan="train_folds")
        # One row per fold: bounded by the years of the data.
        limits = {row["fold"]: row.asDict() for row in learned.collect()}
        last = limits.get(last_fold(roled), {})
        rows = W.test_rows(roled).where(F.col("fold").isin(list(limits)))
        rows = rows.withColumns({f"size_{h}": share * F.greatest(F.abs("up"), F.abs("down")) for h, share in REACH.items()})
        kept = ["fold", "session_id", "state_regime", "coin", "cost", "g", *[f"size_{h}" for h in REACH]]
        near = dict.fromkeys(limits, last)
        return C.bit_sets(rows, kept, conditions, {"chosen": (0, limits), "weaker": (-1, near), "stronger": (1, near)}, "fold")
    return t.stored("opportunity_rows", build)


def last_fold(roled: DataFrame) -> int:
    return roled.agg(F.max(F.get("test_folds", 0))).first()[0] or FIRST


def size(h: int) -> Column:
    return F.col(f"size_{h}")


def spread(rows: DataFrame, kinds: tuple[str, ...] = ("chosen",)) -> DataFrame:
    """A row for every hypothesis that one of the bit sets names: the plain form of what `sums` adds up, for tests and small tables."""
    bits = F.col(kinds[0])
    for kind in kinds[1:]:
        bits = bits.bitwiseOR(F.col(kind))
    bit = F.filter(F.sequence(F.lit(0), F.lit(len(REGISTRY) - 1)), lambda i: F.getbit(bits, i) == 1)
    rows = rows.withColumn("i", F.explode(bit))
    reaches = sorted(REACH)
    # Own horizon and multiple of each hypothesis, by its number.
    place, k = F.get(F.array(*[F.lit(reaches.index(h)) for _, h, *_ in REGISTRY]), F.col("i")), F.get(F.array(*[F.lit(float(k)) for _, _, k, _ in REGISTRY]), F.col("i"))
    rows = rows.withColumns({"mx": F.get(F.array(*[size(h) for h in reaches]), place), "need": k * F.col("cost"), "place": place})
    # A horizon that its excursion does not reach is passed over by every shorter one, as excursions grow with the horizon.
    reach = F.lit(None).cast("int")
    for n, h in reversed(list(enumerate(reaches))):
        reach = F.when((F.col("place") >= n) & (size(h) >= F.col("need")), F.lit(h)).otherwise(reach)
    return rows.select("fold", "ts", "session_id", "state_regime", "cost", "g", F.get(F.array(*[F.lit(name) for name in IDS]), F.col("i")).alias("hypothesis"), *[(F.getbit(F.col(kind), F.col("i")) == 1).alias(f"is_{kind}") for kind in kinds],
                       "mx", F.coalesce(F.col("mx") >= F.col("need"), F.lit(False)).alias("large"), (F.col("mx") - F.col("need")).alias("surplus"), reach.alias("reach"))


HYP = ["hypothesis"]


def told(t: Tables) -> DataFrame:
    rows = [(i, family, h, float(k), 2 if condition["type"] == "all" else 1, f"{h}:{k}") for i, (family, h, k, condition) in zip(IDS, REGISTRY)]
    return F.broadcast(t.spark.createDataFrame(rows, "hypothesis string, family string, horizon int, k double, complexity int, combo string"))


REACHED = [f"reach_{h}" for h in sorted(REACH)]


def sums(t: Tables) -> DataFrame:
    """One row per hypothesis, session and regime: counts and sums of the chosen rows and of the neighbours, and how many rows reach first at each horizon."""
    def build() -> DataFrame:
        specs, reaches = [(h, float(k)) for _, h, k, _ in REGISTRY], sorted(REACH)

        def measure(c, i):
            h, k = specs[i]
            at = (c["chosen"] >> i & 1).nonzero()[0]
            cost, mx = c["cost"][at], c[f"size_{h}"][at]
            need = k * cost
            yield at, {"n": None, "hits": mx >= need, "sum_mx": mx, "sum_cost": cost, "sum_surplus": mx - need}
            left = mx == mx
            for x in reaches:
                # A horizon that its excursion does not reach is passed over by every shorter one, as excursions grow with the horizon.
                if x <= h:
                    now = left & (c[f"size_{x}"][at] >= need)
                    left = left & ~now
                    yield at, {f"reach_{x}": now}
            for kind in ("weaker", "stronger"):
                at = (c[kind] >> i & 1).nonzero()[0]
                yield at, {f"{kind}_n": None, f"{kind}_sum": c[f"size_{h}"][at] - k * c["cost"][at]}
        rows = test_rows(t).select("fold", "session_id", "state_regime", "chosen", "weaker", "stronger", "cost", *[f"size_{h}" for h in REACH])
        return tallies(rows, ["fold", "session_id", "state_regime"], IDS, ["n", "hits", *REACHED, "weaker_n", "stronger_n"], ["sum_mx", "sum_cost", "sum_surplus", "weaker_sum", "stronger_sum"], measure).withColumn("fold", F.col("fold").cast("int"))
    return t.stored("opportunity_sums", build)


LEVELS = {"_q01": 0.01, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "_q99": 0.99}


def levels(t: Tables) -> DataFrame:
    """Quantiles of the excursion (p) and of the surplus (_q) of every hypothesis."""
    def build() -> DataFrame:
        rows = test_rows(t).select("chosen", *[f"size_{h}" for h in REACH], *[(size(h) - float(k) * F.col("cost")).alias(f"surplus_{h}_{k}") for h, k in COMBOS])
        groups = [(f"{kind}:{name}", f"size_{h}" if kind == "p" else f"surplus_{h}_{k}", i) for i, (name, (_, h, k, _)) in enumerate(zip(IDS, REGISTRY)) for kind in ("p", "_q")]
        asked = [(group, n) for group, *_ in groups for n, level in enumerate(LEVELS) if level.startswith(group.split(":")[0])]
        found = column_quantiles(rows, groups, list(LEVELS.values()), asked, names=list(LEVELS), bits="chosen")
        return found.groupBy(F.substring_index("group", ":", -1).alias("hypothesis")).agg(*[F.max(level).alias(level) for level in LEVELS])
    return t.stored("opportunity_levels", build)


def base_rates(t: Tables) -> DataFrame:
    """(session, combo, all_n, all_hits): how often any row is large, per horizon and multiple."""
    def build() -> DataFrame:
        rows = test_rows(t).groupBy("fold", "session_id").agg(F.count(F.lit(1)).alias("all_n"), *[F.count_if(size(h) >= k * F.col("cost")).alias(f"hits_{h}_{k}") for h, k in COMBOS])
        return rows.select("fold", "session_id", "all_n", F.inline(F.array(*[F.struct(F.lit(f"{h}:{k}").alias("combo"), F.col(f"hits_{h}_{k}").alias("all_hits")) for h, k in COMBOS])))
    return t.stored("opportunity_base", build)


def lifts(t: Tables) -> DataFrame:
    """Chosen rate minus the rate of all rows, per hypothesis and session that has chosen rows."""
    per = sums(t).where("n > 0").groupBy(*HYP, "fold", "session_id").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return per.join(told(t), HYP).join(base_rates(t), ["fold", "session_id", "combo"]).select(*HYP, "fold", "session_id", "n", "hits", (F.col("hits") / F.col("n") - F.col("all_hits") / F.col("all_n")).alias("x"))


def fold_lifts(t: Tables) -> DataFrame:
    chosen = lifts(t).groupBy(*HYP, "fold").agg(F.sum("n").alias("eligible"), ratio(F.sum("hits"), F.sum("n")).alias("opportunity_rate"), F.avg("x").alias("rate_lift"))
    base = base_rates(t).groupBy("fold", "combo").agg(F.sum("all_n").alias("baseline"), ratio(F.sum("all_hits"), F.sum("all_n")).alias("baseline_rate"))
    return base.join(told(t), "combo").join(chosen, [*HYP, "fold"], "left").select(*HYP, "fold", F.coalesce("eligible", F.lit(0)).alias("eligible"), "baseline", "opportunity_rate", "baseline_rate", "rate_lift")


SKEPTIC_CHECKS = ("remove_best_5pct", "remove_best_sessions", "winsorised", "cost_1_5x", "weaker_surplus", "stronger_surplus")


def skeptic(t: Tables) -> DataFrame:
    """The attacks on every hypothesis; all but the trimmed means come from the sums."""
    def build() -> DataFrame:
        table = sums(t).join(told(t), HYP)
        per, random = trimmed_sessions(t)
        trimmed = S.attacked_sessions(per, HYP).drop("temporal_concentration", "sample_concentration")
        n = F.sum("n")
        facts = table.groupBy(*HYP).agg(n.alias("support"), ratio(F.sum(F.col("sum_mx") - 1.5 * F.col("k") * F.col("sum_cost")), n).alias("cost_1_5x"), ratio(F.sum(F.col("sum_mx") - 2 * F.col("k") * F.col("sum_cost")), n).alias("cost_2x"),
                                        ratio(F.sum("weaker_sum"), F.sum("weaker_n")).alias("weaker_surplus"), ratio(F.sum("stronger_sum"), F.sum("stronger_n")).alias("stronger_surplus"), ratio(F.sum("hits"), n).alias("selected_rate"))
        years = table.where("n > 0").groupBy(*HYP, F.substring("session_id", 1, 4)).agg(ratio(F.sum("sum_surplus"), F.sum("n")).alias("_m")).groupBy(*HYP).agg(F.count(F.lit(1)).alias("years"), F.count_if(F.col("_m") > 0).alias("positive_years"))
        regimes = table.where("n > 0").groupBy(*HYP, "state_regime").agg(ratio(F.sum("sum_surplus"), F.sum("n")).alias("_m")).groupBy(*HYP).agg(F.min("_m").alias("worst_regime"))
        out = told(t).select(*HYP)
        for part in (trimmed, facts, years, regimes, random):
            out = out.join(part, HYP, "left")
        checks = [(c, F.col(c) > 0) for c in SKEPTIC_CHECKS] + [("year_concentration", F.col("positive_years") >= F.greatest(F.lit(2), F.col("years") - 1))]
        return out.withColumn("failures", failed_names(checks)).drop("support")
    return t.stored("opportunity_skeptic", build)


def trimmed_sessions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """What the attacks read of every session, and the rate of a random condition as frequent as the chosen one: (rows per session, random_rate)."""
    total = base_rates(t).groupBy("combo").agg(F.sum("all_n").alias("_all"))
    shares = sums(t).groupBy(*HYP).agg(F.sum("n").alias("_n")).join(told(t), HYP).join(total, "combo").select(*HYP, (F.col("_n") / F.col("_all")).alias("share"))
    # A few numbers per hypothesis.
    cuts = {row["hypothesis"]: row for row in shares.join(levels(t), HYP, "left").collect()}
    specs = [(h, float(k), *([cuts[name][c] for c in ("share", "_q01", "_q99", "p95")] if name in cuts else [0.0] + [None] * 3)) for name, (_, h, k, _) in zip(IDS, REGISTRY)]
    specs = [tuple(float("nan") if x is None else x for x in spec) for spec in specs]

    def measure(c, i):
        h, k, share, low, high, upper = specs[i]
        at = (c["chosen"] >> i & 1).nonzero()[0]
        mx = c[f"size_{h}"][at]
        value = mx - k * c["cost"][at]
        yield at, {"_rows": None, "_n": value == value, "_s": value, "_ws": value.clip(low, high)}
        below = mx < upper
        yield at[below], {"_tn": value[below] == value[below], "_ts": value[below]}
        at = (c["coin"] < share).nonzero()[0]
        yield at, {"random_n": None, "random_hits": c[f"size_{h}"][at] >= k * c["cost"][at]}
    rows = test_rows(t).select("session_id", "chosen", "coin", "cost", *[f"size_{h}" for h in REACH])
    table = materialize(tallies(rows, ["session_id"], IDS, ["_rows", "_n", "_tn", "random_n", "random_hits"], ["_s", "_ws", "_ts"], measure).withColumn("_m", ratio("_s", "_n")))
    return table.where("_rows > 0"), table.groupBy(*HYP).agg(ratio(F.sum("random_hits"), F.sum("random_n")).alias("random_rate"))


REASON_NAMES = ("gross_edge_to_cost_below_predeclared_K", "opportunity_rate_lift_ci_failed", "minimum_support_failed", "temporal_stability_failed", "opportunity_skeptic_failed", "bh_fdr_failed")


def results(t: Tables) -> DataFrame:
    """Every hypothesis with its gates, reasons and status."""
    def build() -> DataFrame:
        x = lifts(t)
        lift = x.groupBy(*HYP).agg(F.count("x").alias("sessions"), F.avg("x").alias("lift"), F.when(F.count("x") >= 2, F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("se"), F.count_distinct(F.substring("session_id", 1, 4)).alias("years"))
        low, high = interval95("lift", "se")
        lift = lift.withColumns({"ci_low": low, "ci_high": high, "p_value": F.round(F.when(F.col("sessions") < 2, F.lit(1.0)).otherwise(p_positive("lift", "se")), 9)})
        n = F.sum("n")
        facts = sums(t).groupBy(*HYP).agg(n.alias("support"), ratio(F.sum("hits"), n).alias("rate"), *[ratio(F.sum(f"sum_{c}"), n).alias(name) for c, name in (("mx", "move"), ("cost", "cost"), ("surplus", "surplus"))])
        base = base_rates(t).groupBy("combo").agg(F.sum("all_n").alias("_all"), ratio(F.sum("all_hits"), F.sum("all_n")).alias("base_rate"))
        shape = levels(t).select(*HYP, "p50", "p75", "p90", "p95")
        listed = F.array(*[F.struct(F.lit(h).alias("reach"), F.col(f"reach_{h}").alias("_n")) for h in sorted(REACH)])
        reach = sums(t).select(*HYP, F.inline(listed)).groupBy(*HYP, "reach").agg(F.sum("_n").alias("_n")).where("_n > 0").groupBy(*HYP).agg(F.percentile("reach", F.lit(0.5), F.col("_n")).alias("reach_p50"), F.percentile("reach", F.lit(0.75), F.col("_n")).alias("reach_p75"))
        stable = fold_lifts(t).groupBy(*HYP).agg(F.count_if(F.col("rate_lift") > 0).alias("positive_folds"))
        out = told(t).join(base, "combo")
        for part in (facts, lift, shape, reach, stable, skeptic(t).select(*HYP, (F.size("failures") == 0).alias("skeptic_passed"))):
            out = out.join(part, HYP, "left")
        out = out.withColumns({"frequency": ratio("support", "_all"), "edge_to_cost": W.edge_to_cost(F.col("move"), F.col("cost")), "p_value": F.coalesce("p_value", F.lit(1.0)), "_family": F.lit(1)})
        out = R.benjamini_hochberg(out, "p_value", ["_family"], "hypothesis", "q_value")
        support = (F.col("support") >= LEAST_ROWS) & (F.col("sessions") >= LEAST_SESSIONS) & (F.col("years") >= LEAST_YEARS)
        steady = (F.col("years") >= LEAST_YEARS) & (F.col("positive_folds") >= F.greatest(F.lit(2), F.col("years") - 1))
        checks = zip(REASON_NAMES, (F.col("edge_to_cost") > F.col("k"), F.col("ci_low") > 0, support, steady, F.col("skeptic_passed"), F.col("q_value") <= 0.05))
        out = out.withColumn("reasons", failed_names(list(checks))).withColumn("status", F.when(F.size("reasons") == 0, "OPPORTUNITY_SURVIVOR").otherwise("REJECTED"))
        out = out.withColumn("_u", F.abs(F.coalesce("lift", F.lit(0.0)))).withColumn("opportunity_value", W.opportunity_value("move", "cost", "frequency", "_u", "complexity"))
        value = 0.35 * F.least(F.lit(1.0), F.col("edge_to_cost") / 3) + 0.2 * F.least(F.lit(1.0), F.col("frequency") / 0.1) + 0.15 * (1 - F.col("q_value")) + 0.15 * F.least(F.lit(1.0), F.col("sessions") / 500) - 0.08 * F.col("complexity")
        return out.withColumn("research_value", value).drop("_u", "_all", "_family", "combo")
    return t.stored("opportunity_results", build)


DIRECTIONS = ("hypothesis string, action string, expected_net double, se double, ci_low double, ci_high double, p_value double, support bigint, expected_gross double, expected_cost double, stress_0_75 double, "
              "stress_1_25 double, stress_1_5 double, stress_2_0 double, remove_best_5pct double, remove_best_sessions double, winsorised double, stable boolean, skeptic_passed boolean, id string, q_value double, status string")


def directions(t: Tables) -> DataFrame:
    """Both actions of the surviving hypotheses only."""
    def build() -> DataFrame:
        # A name per survivor.
        survivors = sorted(row["hypothesis"] for row in results(t).where("status = 'OPPORTUNITY_SURVIVOR'").select(*HYP).collect())
        if not survivors:
            return t.spark.createDataFrame([], DIRECTIONS)
        tests = [(IDS.index(name), side) for name in survivors for side in ("long", "short")]
        ids = [f"{IDS[i]}-ENTER_{side.upper()}" for i, side in tests]
        rows = test_rows(t).select("session_id", "chosen", "g", "cost", (F.col("g") - F.col("cost")).alias("net_long"), (-F.col("g") - F.col("cost")).alias("net_short"))
        found = column_quantiles(rows, [(name, f"net_{side}", i) for name, (i, side) in zip(ids, tests)], [0.01, 0.95, 0.99], [(name, n) for name in ids for n in range(3)], bits="chosen")
        # Three numbers per survivor and side.
        cuts = {row["group"]: tuple(row)[1:] for row in found.collect()}
        limits = [cuts.get(name, (float("nan"),) * 3) for name in ids]

        def measure(c, j):
            (i, side), (low, upper, high) = tests[j], limits[j]
            at = (c["chosen"] >> i & 1).nonzero()[0]
            gross, cost, net = c["g"][at] if side == "long" else -c["g"][at], c["cost"][at], c[f"net_{side}"][at]
            yield at, {"_rows": None, "_n": net == net, "_s": net, "_ws": net.clip(low, high), "gross": gross, "gross_n": gross == gross, "cost": cost, "cost_n": cost == cost,
                       **{f"stress_{str(m).replace('.', '_')}": gross - m * cost for m in (0.75, 1.25, 1.5, 2.0)}}
            below = net < upper
            yield at[below], {"_tn": None, "_ts": net[below]}
        stressed = [f"stress_{str(m).replace('.', '_')}" for m in (0.75, 1.25, 1.5, 2.0)]
        per = tallies(rows, ["session_id"], ids, ["_rows", "_n", "_tn", "gross_n", "cost_n"], ["_s", "_ws", "_ts", "gross", "cost", *stressed], measure, "id")
        per = materialize(per.select(F.substring_index("id", "-ENTER_", 1).alias("hypothesis"), F.concat(F.lit("ENTER_"), F.substring_index("id", "_", -1)).alias("action"), *[c for c in per.columns if c != "id"], ratio("_s", "_n").alias("_m")))
        by = [*HYP, "action"]
        ci = E.clustered_sessions(per.where("_n > 0"), by).select(*by, F.col("mean").alias("expected_net"), "se", "ci_low", "ci_high", F.round("p_value", 9).alias("p_value"))
        hits = S.attacked_sessions(per, by).drop("mean", "temporal_concentration", "sample_concentration")
        facts = per.groupBy(*by).agg(F.sum("_rows").alias("support"), ratio(F.sum("gross"), F.sum("gross_n")).alias("expected_gross"), ratio(F.sum("cost"), F.sum("cost_n")).alias("expected_cost"), *[ratio(F.sum(c), F.sum("_n")).alias(c) for c in stressed])
        years = per.groupBy(*by, F.substring("session_id", 1, 4)).agg(ratio(F.sum("_s"), F.sum("_n")).alias("_m")).groupBy(*by).agg(F.count(F.lit(1)).alias("_y"), F.count_if(F.col("_m") > 0).alias("_good"))
        out = ci.join(facts, by).join(years, by).join(hits, by).withColumn("_family", F.lit(1))
        attacks = [F.col(c) > 0 for c in ("remove_best_5pct", "remove_best_sessions", "winsorised", "stress_1_5", "stress_2_0")]
        passed = attacks[0]
        for one in attacks[1:]:
            passed = passed & one
        out = out.withColumns({"stable": (F.col("_y") >= LEAST_YEARS) & (F.col("_good") >= F.greatest(F.lit(2), F.col("_y") - 1)), "skeptic_passed": F.coalesce(passed, F.lit(False)), "id": F.concat_ws("-", "hypothesis", "action")})
        out = R.benjamini_hochberg(out, "p_value", ["_family"], "id", "q_value")
        ok = (F.col("expected_net") > 0) & (F.col("ci_low") > 0) & (F.col("q_value") <= 0.05) & F.col("stable") & F.col("skeptic_passed")
        return out.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "DIRECTION_SURVIVOR").otherwise("REJECTED")).drop("_y", "_good", "_family")
    return t.stored("opportunity_directions", build)


# ---- comparison SQL: every hypothesis on its own, from rows -------------------------------------------

def _expression(x: str) -> str:
    return x.replace("0D", "0::DOUBLE").replace(".5D", ".5::DOUBLE").replace("0.6D", "0.6::DOUBLE").replace("0.08D", "0.08::DOUBLE").replace("0.004D", "0.004::DOUBLE").replace("0.03D", "0.03::DOUBLE")


def _chosen_sql(c: dict, n: int, source: str) -> str:
    if c["type"] == "all":
        return "(" + " AND ".join(_chosen_sql(clause, n, source) for clause in c["clauses"]) + ")"
    if c["type"] == "minute_range":
        return f"minute BETWEEN {max(0, c['start'] + 15 * n) if n else c['start']} AND {min(270, c['end'] + 15 * n) if n else c['end']}"
    q = C.clipped_quantile(c["quantile"], n) if n else c["quantile"]
    return f"coalesce({c['field']} {'>=' if c['type'].endswith('gte') else '<='} {source}.q_{c['field']}_{round(q * 1000)}, false)"


def _learned_sql(needs: set) -> str:
    return ", ".join(f"quantile_cont({f}, {q}) AS q_{f}_{round(q * 1000)}" for f, q in sorted(needs))


def _hypothesis_sql(i: int) -> str:
    _, h, k, c = REGISTRY[i]
    reach = " ".join(f"WHEN {REACH[x]} * greatest(abs(up), abs(down)) >= {k} * cost THEN {x}" for x in sorted(REACH) if x <= h)
    mx = f"{REACH[h]} * greatest(abs(up), abs(down))"
    return (f"SELECT '{IDS[i]}' AS hypothesis, {k}::DOUBLE AS k, {2 if c['type'] == 'all' else 1} AS complexity, {h} AS horizon, '{REGISTRY[i][0]}' AS family, tst.fold, session_id, state_regime, cost, g, coin, {mx} AS mx, coalesce({mx} >= {k} * cost, false) AS large, {mx} - {k} * cost AS surplus, "
            f"CASE {reach} END AS reach, {_chosen_sql(c, 0, 'lf')} AS chosen, {_chosen_sql(c, -1, 'ln')} AS weaker, {_chosen_sql(c, 1, 'ln')} AS stronger FROM tst JOIN lf ON tst.fold = lf.fold, ln")


_ALL = [c for *_, c in REGISTRY]
ROWS_SQL = "WITH led AS (SELECT l_shipdate AS ts, l_shipdate::DATE::VARCHAR AS session_id, CASE l_returnflag WHEN 'R' THEN 'RANGE' WHEN 'A' THEN 'TREND_UP' ELSE 'TREND_DOWN' END AS state_regime, ('0x' || substr(md5('rand:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS coin, " + ", ".join(
    f"{_expression(x)} AS {name}" for name, x in (STATES | OUTCOMES).items()) + " FROM lineitem)" + folds_sql("led") + f""", tst AS MATERIALIZED (SELECT * FROM folds WHERE role = 'TEST'),
 lf AS MATERIALIZED (SELECT fold, {_learned_sql(set().union(*[C.quantile_needs(c) for c in _ALL]))} FROM folds WHERE role = 'TRAIN' GROUP BY fold),
 ln AS MATERIALIZED (SELECT {_learned_sql(set().union(*[C.quantile_needs(c, n) for c in _ALL for n in (-1, 1)]))} FROM folds WHERE role = 'TRAIN' AND fold = (SELECT max(fold) FROM tst)),
 sel AS MATERIALIZED ({" UNION ALL ".join(map(_hypothesis_sql, range(len(REGISTRY))))})"""
FOLD_LIFT_SQL = """, px AS (SELECT hypothesis, fold, session_id, avg(CASE WHEN chosen THEN large::INT END) - avg(large::INT) AS x FROM sel GROUP BY ALL), fl AS (SELECT hypothesis, fold, avg(x) AS rate_lift FROM px GROUP BY ALL)"""
SKEPTIC_SQL = ", e AS (SELECT * FROM sel WHERE chosen)" + attack_sql("hypothesis", "surplus", "mx") + """, st AS (SELECT hypothesis, avg(mx - 1.5 * k * cost) AS cost_1_5x, avg(mx - 2.0 * k * cost) AS cost_2x FROM e GROUP BY 1), sr AS (SELECT hypothesis, avg(chosen::INT) AS share FROM sel GROUP BY 1),
 nb AS (SELECT hypothesis, avg(CASE WHEN weaker THEN surplus END) AS weaker_surplus, avg(CASE WHEN stronger THEN surplus END) AS stronger_surplus, avg(CASE WHEN coin < share THEN large::INT END) AS random_rate, avg(CASE WHEN chosen THEN large::INT END) AS selected_rate FROM sel JOIN sr USING (hypothesis) GROUP BY 1),
 yr AS (SELECT hypothesis, count(*) AS years, count(*) FILTER (m > 0) AS positive_years FROM (SELECT hypothesis, substr(session_id, 1, 4) AS y, avg(surplus) AS m FROM e GROUP BY ALL) GROUP BY 1), rm AS (SELECT hypothesis, min(m) AS worst_regime FROM (SELECT hypothesis, state_regime, avg(surplus) AS m FROM e GROUP BY ALL) GROUP BY 1),
 al AS MATERIALIZED (SELECT * FROM att JOIN st USING (hypothesis) JOIN nb USING (hypothesis) JOIN yr USING (hypothesis) JOIN rm USING (hypothesis)), sk AS (SELECT *, """ + reasons_sql([(c, f"{c} > 0") for c in SKEPTIC_CHECKS] + [("year_concentration", "positive_years >= greatest(2, years - 1)")]) + " AS failures FROM al)"
RESULT_SQL = ROWS_SQL + FOLD_LIFT_SQL + SKEPTIC_SQL + f""", lf8 AS (SELECT hypothesis, count(x) AS sessions, avg(x) AS lift, CASE WHEN count(x) >= 2 THEN stddev_samp(x) / sqrt(count(x)) END AS se, count(DISTINCT CASE WHEN x IS NOT NULL THEN substr(session_id, 1, 4) END) AS years FROM px GROUP BY 1),
 ag AS (SELECT hypothesis, any_value(family) AS family, any_value(k) AS k, any_value(horizon) AS horizon, any_value(complexity) AS complexity, count(*) FILTER (chosen) AS support, count(*) FILTER (chosen) / count(*) AS frequency, avg(CASE WHEN chosen THEN large::INT END) AS rate, avg(large::INT) AS base_rate, avg(CASE WHEN chosen THEN mx END) AS move,
  avg(CASE WHEN chosen THEN cost END) AS cost, avg(CASE WHEN chosen THEN surplus END) AS surplus, {", ".join(f"quantile_cont(CASE WHEN chosen THEN mx END, {q}) AS p{round(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95))}, quantile_cont(CASE WHEN chosen THEN reach END, 0.5) AS reach_p50, quantile_cont(CASE WHEN chosen THEN reach END, 0.75) AS reach_p75 FROM sel GROUP BY 1),
 j8 AS (SELECT *, lift - 1.96 * se AS ci_low, lift + 1.96 * se AS ci_high, coalesce(round(CASE WHEN sessions < 2 THEN 1.0 ELSE {p_sql('lift', 'se')} END, 9), 1.0) AS p_value, move / nullif(cost, 0) AS edge_to_cost FROM ag JOIN lf8 USING (hypothesis)),
 k8 AS (SELECT *, row_number() OVER (ORDER BY p_value, hypothesis) AS place, count(*) OVER () AS number FROM j8), q8 AS (SELECT *, least(1.0, min(p_value * number / place) OVER (ORDER BY place DESC)) AS q_value FROM k8),
 s8 AS (SELECT q8.*, pf.positive_folds, len(sk.failures) = 0 AS skeptic_passed FROM q8 LEFT JOIN (SELECT hypothesis, count(*) FILTER (rate_lift > 0) AS positive_folds FROM fl GROUP BY 1) pf USING (hypothesis) LEFT JOIN sk USING (hypothesis)),
 res AS MATERIALIZED (SELECT *, {reasons_sql(list(zip(REASON_NAMES, ("edge_to_cost > k", "ci_low > 0", f"support >= {LEAST_ROWS} AND sessions >= {LEAST_SESSIONS} AND years >= {LEAST_YEARS}", f"years >= {LEAST_YEARS} AND positive_folds >= greatest(2, years - 1)", "skeptic_passed", "q_value <= 0.05"))))} AS reasons,
  greatest(0.0, 0.45 * least(1.0, edge_to_cost / 3) + 0.25 * least(1.0, greatest(0.0, frequency) / 0.1) + 0.2 * greatest(0.0, 1 - least(1.0, abs(lift) / 0.25)) - 0.08 * complexity) AS opportunity_value,
  0.35 * least(1.0, edge_to_cost / 3) + 0.2 * least(1.0, frequency / 0.1) + 0.15 * (1 - q_value) + 0.15 * least(1.0, sessions / 500) - 0.08 * complexity AS research_value FROM s8)"""
DIRECTION_SQL = RESULT_SQL + f""", d9 AS (SELECT hypothesis || '-' || a AS id, hypothesis, a AS action, session_id, cost, CASE a WHEN 'ENTER_LONG' THEN g ELSE -g END AS gross, CASE a WHEN 'ENTER_LONG' THEN g ELSE -g END - cost AS net
  FROM sel JOIN res USING (hypothesis) CROSS JOIN (VALUES ('ENTER_LONG'), ('ENTER_SHORT')) v(a) WHERE chosen AND len(reasons) = 0)""".replace("session_id, cost,", "session_id, sel.cost,").replace("- cost AS net", "- sel.cost AS net") + (
    attack_sql("id", "net", "net", "d9").replace("qs AS", "qs9 AS").replace("ss AS", "ss9 AS").replace("conc AS", "conc9 AS").replace("att AS", "att9 AS").replace("JOIN qs ", "JOIN qs9 ").replace("JOIN ss ", "JOIN ss9 ").replace("FROM ss ", "FROM ss9 ")) + f""",
 m9 AS (SELECT id, any_value(hypothesis) AS hypothesis, any_value(action) AS action, avg(net) AS mu, avg(gross) AS expected_gross, avg(cost) AS expected_cost, count(*) AS support, {", ".join(f"avg(gross - {m} * cost) AS stress_{str(m).replace('.', '_')}" for m in (0.75, 1.25, 1.5, 2.0))} FROM d9 GROUP BY id),
 c9 AS (SELECT id, sqrt(sum((sv - mu * n) * (sv - mu * n)) * count(*) / (count(*) - 1)) / max(support) AS se FROM (SELECT id, session_id, sum(net) AS sv, count(*) AS n FROM d9 GROUP BY ALL) JOIN m9 USING (id) GROUP BY id),
 y9 AS (SELECT id, count(*) >= {LEAST_YEARS} AND count(*) FILTER (x > 0) >= greatest(2, count(*) - 1) AS stable FROM (SELECT id, substr(session_id, 1, 4) AS y, avg(net) AS x FROM d9 GROUP BY ALL) GROUP BY id),
 p9 AS (SELECT m9.*, se, stable, round({p_sql('mu', 'se')}, 9) AS p_value, coalesce(remove_best_5pct > 0 AND remove_best_sessions > 0 AND winsorised > 0 AND stress_1_5 > 0 AND stress_2_0 > 0, false) AS skeptic_passed FROM m9 JOIN c9 USING (id) JOIN y9 USING (id) JOIN att9 USING (id)),
 r9 AS (SELECT *, row_number() OVER (ORDER BY p_value, id) AS place, count(*) OVER () AS number FROM p9), q9 AS (SELECT *, least(1.0, min(p_value * number / place) OVER (ORDER BY place DESC)) AS q_value FROM r9),
 dir AS (SELECT *, CASE WHEN mu > 0 AND mu - 1.96 * se > 0 AND q_value <= 0.05 AND stable AND skeptic_passed THEN 'DIRECTION_SURVIVOR' ELSE 'REJECTED' END AS status FROM q9)"""

COLUMNS = ("frequency", "rate", "base_rate", "lift", "se", "ci_low", "ci_high", "p_value", "q_value", "move", "cost", "surplus", "edge_to_cost", "p50", "p75", "p90", "p95", "reach_p50", "reach_p75", "opportunity_value", "research_value")


@query("w08_opportunity_results", RESULT_SQL + f" SELECT hypothesis, family, horizon, k, complexity, support, sessions, years, positive_folds, skeptic_passed, {', '.join(f'{r(c, 5)} AS {c}' for c in COLUMNS)}, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'OPPORTUNITY_SURVIVOR' ELSE 'REJECTED' END AS status FROM res")
def opportunity_results(t: Tables) -> DataFrame:
    out = results(t)
    return out.select("hypothesis", "family", "horizon", "k", "complexity", "support", "sessions", "years", "positive_folds", "skeptic_passed", *[rounded(c, 5).alias(c) for c in COLUMNS], F.concat_ws(",", "reasons").alias("reasons"), "status")


@query("w08_opportunity_folds", ROWS_SQL + FOLD_LIFT_SQL + f" SELECT hypothesis, fold, count(*) FILTER (chosen) AS eligible, count(*) AS baseline, {r('avg(CASE WHEN chosen THEN large::INT END)')} AS opportunity_rate, {r('avg(large::INT)')} AS baseline_rate, {r('max(rate_lift)')} AS rate_lift FROM sel JOIN fl USING (hypothesis, fold) GROUP BY ALL")
def opportunity_folds(t: Tables) -> DataFrame:
    """Every hypothesis in every test year."""
    return rounded_all(fold_lifts(t), ["opportunity_rate", "baseline_rate", "rate_lift"])


ATTACKED = ("mean", "remove_best_5pct", "remove_best_sessions", "winsorised", "cost_1_5x", "cost_2x", "weaker_surplus", "stronger_surplus", "random_rate", "selected_rate", "worst_regime")


@query("t12_opportunity_skeptic", ROWS_SQL + SKEPTIC_SQL + f" SELECT hypothesis, {', '.join(f'{r(c)} AS {c}' for c in ATTACKED)}, years, positive_years, array_to_string(failures, ',') AS failures FROM sk")
def opportunity_skeptic(t: Tables) -> DataFrame:
    """Attacks on each of the thirty hypotheses, its years and regimes, and the attacks that it fails."""
    return rounded_all(skeptic(t).withColumn("failures", F.concat_ws(",", "failures")), list(ATTACKED))


MONEY = ("expected_gross", "expected_cost", "expected_net", "se", "ci_low", "ci_high", "p_value", "q_value", "stress_0_75", "stress_1_25", "stress_1_5", "stress_2_0")


@query("w09_direction_test", DIRECTION_SQL + f" SELECT hypothesis, action, support, {', '.join(f'{r(x)} AS {c}' for c, x in zip(MONEY, ('expected_gross', 'expected_cost', 'mu', 'se', 'mu - 1.96 * se', 'mu + 1.96 * se', 'p_value', 'q_value', 'stress_0_75', 'stress_1_25', 'stress_1_5', 'stress_2_0')))}, stable, skeptic_passed, status FROM dir")
def direction_test(t: Tables) -> DataFrame:
    return directions(t).select("hypothesis", "action", "support", *[rounded(c).alias(c) for c in MONEY], "stable", "skeptic_passed", "status")


@query("w08_final_status", DIRECTION_SQL + " SELECT hypothesis, family, CASE WHEN len(reasons) > 0 THEN 'REJECTED' WHEN hypothesis IN (SELECT hypothesis FROM dir WHERE status = 'DIRECTION_SURVIVOR') THEN 'DEV_ECONOMIC_SURVIVOR' ELSE 'VOLATILITY_OPPORTUNITY_ONLY' END AS status FROM res")
def final_status(t: Tables) -> DataFrame:
    """What becomes of a hypothesis once its directions are tested."""
    won = directions(t).where("status = 'DIRECTION_SURVIVOR'").select(*HYP).distinct().withColumn("_won", F.lit(True))
    status = F.when(F.col("status") == "REJECTED", F.lit("REJECTED")).when(F.col("_won"), F.lit("DEV_ECONOMIC_SURVIVOR")).otherwise(F.lit("VOLATILITY_OPPORTUNITY_ONLY"))
    return results(t).join(won, HYP, "left").select("hypothesis", "family", status.alias("status"))
