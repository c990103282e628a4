"""From hypotheses to verdicts: one table of sums per hypothesis and session, everything else derived from it.

A hypothesis names a condition, a target, an action, an expected direction (GREATER or LESS) and neighbours of its parameter. One scan
reduces the rows to sums and counts under the condition and outside of it, for the target, its stressed costs, the neighbours, a random
condition and the outcome of seven sessions before. Values of a hypothesis that expects LESS change their sign at the scan, so that further
on a favourable effect is a positive one. Sessions are days or blocks of days: tables by session grow with the calendar, not with the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.hashing import draw_index
from barwright.functions.numeric import ratio
from barwright.operators import conditions as C, effects as E, resampling as R, stability as S
from barwright.operators.tallies import tallies
from barwright.session import materialize

BY = ["hypothesis"]
RANDOM = {"type": "session_hash_mod", "modulus": 10, "remainder": 3}
# Multiples of the cost at which a tradable target has to hold (fixed values), and sessions by which a control is late.
MULTIPLIERS, LATE = (1.0, 1.25, 1.5, 2.0), 7


def sign(spec: Mapping) -> int:
    return 1 if spec["direction"] == "GREATER" else -1


def quantiles_needed(specs: Sequence[Mapping]) -> set[tuple[str, float]]:
    needs = set()
    for spec in specs:
        needs |= C.quantile_needs(spec["condition"])
        if spec["condition"]["type"].startswith("quantile_"):
            needs |= {(spec["condition"]["field"], q) for q in spec["neighbours"]}
    return needs


def late_outcomes(rows: DataFrame, targets: Sequence[str], slot: Sequence[str], session: str = "session_id") -> DataFrame:
    """Rows with late_<target>: the mean of the target in the same slot of the day, LATE sessions of that slot earlier."""
    means = rows.groupBy(*slot, session).agg(*[F.avg(target).alias(target) for target in targets])
    before = Window.partitionBy(*slot).orderBy(session)
    late = means.select(*slot, session, *[F.lag(target, LATE).over(before).alias(f"late_{target}") for target in targets])
    # A row per slot and session: bounded by the calendar, whatever the number of rows.
    return rows.join(F.broadcast(late), [*slot, session])


def sums(rows: DataFrame, specs: Sequence[Mapping], session: str = "session_id", limits: Mapping[str, float] | None = None) -> DataFrame:
    """One row per hypothesis and session. `rows` holds targets, late_<target>, gross and cost where a target is tradable, and thresholds that
    `limits` does not tell.

    n1, s1 count and sum the target under the condition, n0, s0 outside; a_ and b_ are the neighbours, r_ the random condition, l_ the late
    outcome; g and c are the gross return and the cost where both are known; condition_rows counts all rows under the condition.
    """
    limits, tests, plans = limits or {}, {}, []

    def clause(spec: Mapping, override: float | None = None) -> list[str]:
        """Names of the clauses of a condition; a clause compares a column with a number, a column, or is a boolean column."""
        if spec["type"] == "all":
            return [name for one in spec["clauses"] for name in clause(one)]
        kind, field = spec["type"], spec.get("field", "")
        if kind == "minute_range":
            test = (field, spec["start"], spec["end"] if override is None else override)
        elif kind in ("quantile_gte", "quantile_lte"):
            limit = C.threshold_name(field, spec["quantile"] if override is None else override)
            limit = (float("nan") if limits[limit] is None else limits[limit]) if limit in limits else limit
            test = (field, limit, None) if kind == "quantile_gte" else (field, None, limit)
        else:
            test = C.condition(spec, override=override)
        name = f"_c{len(tests)}"
        tests[name] = test
        return [name]

    for spec in specs:
        near = [clause(spec["condition"], value) for value in spec["neighbours"]][:2]
        traded = spec.get("gross") is not None
        plans.append((sign(spec), clause(spec["condition"]), list(zip("ab", near)), spec["target"], f"late_{spec['target']}", (spec["gross"], spec["cost"]) if traded else None))
    numbers = {c for _, _, _, target, late, traded in plans for c in (target, late, *(traded or ()))}
    numbers |= {c for test in tests.values() if isinstance(test, tuple) for c in test if isinstance(c, str)}
    flags = {name: test for name, test in tests.items() if not isinstance(test, tuple)}
    compared = {name: test for name, test in tests.items() if isinstance(test, tuple)}
    source = rows.select(F.col(session).alias("session_id"), *[F.col(c).cast("double").alias(c) for c in sorted(numbers)], *[flag.alias(name) for name, flag in flags.items()])

    def measure(columns, i):
        factor, main, near, target, late, traded = plans[i]

        def met(names):
            out = None
            for name in names:
                if name in compared:
                    field, low, high = compared[name]
                    one = columns[field] == columns[field]
                    for limit, above in ((low, True), (high, False)):
                        if limit is not None:
                            limit = columns[limit] if isinstance(limit, str) else limit
                            one = one & (columns[field] >= limit if above else columns[field] <= limit)
                else:
                    one = columns[name].astype(bool)
                out = one if out is None else out & one
            return out
        at, v = met(main).nonzero()[0], factor * columns[target]
        whole, known = slice(None), v == v
        yield whole, {"rows": known, "s": v}
        yield at, {"condition_rows": None, "n1": known[at], "s1": v[at]}
        for prefix, names in near:
            there = met(names).nonzero()[0]
            yield there, {f"{prefix}_n1": known[there], f"{prefix}_s1": v[there]}
            yield whole, {f"{prefix}_n": known}
        more = {"l": factor * columns[late], **({"g": factor * columns[traded[0]], "c": factor * columns[traded[1]]} if traded else {})}
        for prefix, value in more.items():
            yield whole, {f"{prefix}_n": value == value, f"{prefix}_s": value}
            yield at, {f"{prefix}_n1": (value == value)[at], f"{prefix}_s1": value[at]}

    parts = ("a", "b", "l", "g", "c")
    table = tallies(source, ["session_id"], [spec["id"] for spec in specs], ["condition_rows", "rows", "n1", *[f"{p}_{n}" for p in parts for n in ("n", "n1")]], ["s", "s1", *[f"{p}_{x}" for p in parts for x in ("s", "s1") if (p, x) not in (("a", "s"), ("b", "s"))]], measure)
    random = C.condition(RANDOM)

    def outside(prefix: str, whole_n: str, whole_s: str) -> list[Column]:
        """The sums under the condition and, as the rest of all rows, outside of it; nothing is known of a neighbour that does not exist."""
        n0 = F.col(whole_n) - F.col(f"{prefix}n1")
        return [F.col(f"{prefix}n1"), F.when(F.col(f"{prefix}n1") > 0, F.col(f"{prefix}s1")).alias(f"{prefix}s1"), n0.alias(f"{prefix}n0"), F.when(n0 > 0, F.col(whole_s) - F.col(f"{prefix}s1")).alias(f"{prefix}s0")]

    # The random condition chooses whole sessions.
    drawn = [F.when(on, F.col("rows")).otherwise(F.lit(0)).alias(f"r_n{side}") for side, on in ((1, random), (0, ~random))] + [F.when(on & (F.col("rows") > 0), F.col("s")).alias(f"r_s{side}") for side, on in ((1, random), (0, ~random))]
    return table.select(*BY, "session_id", "condition_rows", "rows", *outside("", "rows", "s"), *outside("a_", "a_n", "s"), *outside("b_", "b_n", "s"), *drawn, *[c for p in ("l", "g", "c") for c in outside(f"{p}_", f"{p}_n", f"{p}_s")])


def effects(table: DataFrame, period: Sequence[Column]) -> DataFrame:
    """(hypothesis, variant, effect, ...) from the sums: MAIN, NEIGHBOUR_a, NEIGHBOUR_b, RANDOM, LATE, COST_m, and PERIOD_p for every period."""
    def variant(name: Column, inside: Column, outside: Column) -> Column:
        return F.struct(name.alias("variant"), inside.alias("conditioned"), outside.alias("baseline"))

    def mean(prefix: str, side: str) -> Column:
        return ratio(f"{prefix}s{side}", f"{prefix}n{side}")

    def stressed(multiple: float, side: str) -> Column:
        return mean("g_", side) - multiple * mean("c_", side)

    main = (mean("", "1"), mean("", "0"))
    listed = [variant(F.lit("MAIN"), *main), *[variant(F.lit(name), mean(p, "1"), mean(p, "0")) for name, p in (("NEIGHBOUR_a", "a_"), ("NEIGHBOUR_b", "b_"), ("RANDOM", "r_"), ("LATE", "l_"))],
              *[variant(F.lit(f"COST_{m}"), stressed(m, "1"), stressed(m, "0")) for m in MULTIPLIERS], *[variant(F.concat(F.lit("PERIOD_"), p), *main) for p in period]]
    means = table.select(*BY, "rows", F.inline(F.array(*listed))).where("conditioned IS NOT NULL OR baseline IS NOT NULL")
    return E.effect_summary(means, [*BY, "variant"])


def session_sample(table: DataFrame) -> DataFrame:
    """The effect sample of MAIN, one row per hypothesis and session (or per side, where sessions do not pair)."""
    means = table.select(*BY, "session_id", ratio("s1", "n1").alias("conditioned"), ratio("s0", "n0").alias("baseline"), "rows").where("rows > 0")
    return E.influence(means, E.effect_summary(means, BY), BY)


def resampled_means(sample: DataFrame, observed: DataFrame, count: int, seed: str) -> DataFrame:
    """(hypothesis, resample, mean) of sessions drawn with replacement, the two sides of an unpaired hypothesis apart.

    The effects of a side are one array, bounded by the calendar; a draw looks into it, so resamples are not shuffled.
    """
    # Samples of sides are centred on the other side's mean: their means add up to the effect of the draw plus the observed one.
    sides = sample.groupBy(*BY, "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "effect"))), lambda x: x["effect"]).alias("_e"))
    parts = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = sides.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("resample")).repartition(parts, *BY, "resample")
    n = F.size("_e")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda sum_, pos: sum_ + F.get(F.col("_e"), draw_index(n, F.lit(seed), F.col("side"), F.col("resample"), pos).cast("int")))
    means = drawn.select(*BY, "resample", (total / n).alias("_m")).groupBy(*BY, "resample").agg(F.sum("_m").alias("_m"), F.count(F.lit(1)).alias("_k"))
    return means.join(observed, BY).select(*BY, "resample", (F.col("_m") - (F.col("_k") - 1) * F.col("observed")).alias("mean"))


def permutation(sample: DataFrame, count: int, seed: str) -> DataFrame:
    """(hypothesis, p_value): signs flipped per session where sessions pair, labels dealt anew where they do not."""
    placed = materialize(R.positions(sample, BY, ["session_id", "side"]))
    paired = R.sign_flip_test(placed.where("side = 'PAIR'"), BY, count, F.lit(seed))
    other = placed.where("side <> 'PAIR'")
    return paired.unionByName(R.label_permutation_test(other, BY, count, F.lit(seed))).select(*BY, "p_value")


def pivoted(found: DataFrame, names: Mapping[str, str]) -> list[Column]:
    return [F.max(F.when(F.col("variant") == variant, F.col("effect"))).alias(name) for name, variant in names.items()]


def facts(table: DataFrame, specs: Sequence[Mapping], period: Sequence[Column], year: Column, blocking: DataFrame, draws: int, flips: int, seed: str = "S") -> DataFrame:
    """One row per hypothesis with all that a verdict reads. `blocking` has one row and one column: whether the data has blocking errors."""
    table = materialize(table)
    found = materialize(effects(table, period))
    good = (F.col("effect") > 0).cast("double")
    known = F.col("effect").isNotNull()
    is_period, is_cost, is_parameter = F.col("variant").startswith("PERIOD_"), F.col("variant").startswith("COST_"), F.col("variant").isin("MAIN", "NEIGHBOUR_a", "NEIGHBOUR_b")
    size = F.when(is_period & (F.length("variant") == 11), F.abs("effect"))
    shape = found.groupBy(*BY).agg(
        *pivoted(found, {"effect": "MAIN", "random_effect": "RANDOM", "late_effect": "LATE", "cost_2x_effect": "COST_2.0"}), F.max(F.when(F.col("variant") == "MAIN", F.col("sessions"))).alias("sessions"),
        F.max(F.when(F.col("variant") == "MAIN", F.col("paired"))).alias("paired"), F.avg(F.when(is_period & known, good)).alias("temporal_favourable"),
        F.coalesce(ratio(F.max(size), F.sum(size)), F.lit(1.0)).alias("year_concentration"), F.coalesce(F.avg(F.when(is_cost & known, good)), F.lit(1.0)).alias("cost_favourable"),
        F.avg(F.when(is_parameter & known, good)).alias("parameter_favourable"))
    support = table.where("condition_rows > 0").groupBy(*BY).agg(F.sum("condition_rows").alias("condition_rows"), F.count(F.lit(1)).alias("condition_sessions"), F.count_distinct(year).alias("condition_years"))
    level = table.groupBy(*BY).agg(ratio(F.sum("s1"), F.sum("n1")).alias("conditioned_mean"), (F.sum("g_n1") > 0).alias("tradable"))
    sample = materialize(session_sample(table))
    boot = R.bootstrap_summary(resampled_means(sample, shape.select(*BY, F.col("effect").alias("observed")), draws, seed), shape.select(*BY, F.col("effect").alias("observed")), BY)
    attacked = S.skeptic(sample, BY).join(shape.select(*BY, "temporal_favourable", "cost_2x_effect"), BY).join(level.select(*BY, "tradable"), BY)
    attacked = attacked.join(F.broadcast(blocking.toDF("_blocking"))).withColumn("_cost", F.when(F.col("tradable"), F.coalesce(F.col("cost_2x_effect") > 0, F.lit(False))))
    attacked = S.skeptic_survival(attacked, F.col("temporal_favourable"), F.col("_cost"), F.col("_blocking")).select(*BY, (~F.col("_blocking")).alias("quality_ok"), F.col("survival").alias("skeptic_survival"))
    told = F.array(*[F.struct(F.lit(s["id"]).alias("hypothesis"), F.lit(s["family"]).alias("family"), F.lit(s["action"]).alias("action"), F.lit(s["direction"]).alias("direction"),
                              F.lit(s["minimum_effect"]).alias("minimum_effect"), F.lit(1 + len(s["neighbours"])).alias("planned")) for s in specs])
    out = table.sparkSession.range(1).select(F.inline(told))
    for part in (shape, support, level, permutation(sample, flips, seed), attacked, boot.select(*BY, F.col("favourable").alias("bootstrap_favourable"), "sign_stability", "ci95_low", "ci95_high")):
        out = out.join(part, BY)
    limit = S.negative_control_limit(F.col("effect"))
    late = F.coalesce(F.abs("late_effect") <= limit, F.lit(False))
    return out.withColumns({"controls_passed": S.negative_control_passed(F.col("effect"), [F.col("late_effect"), F.col("random_effect")]), "slow_passed": late})
