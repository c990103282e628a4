"""Temporal learning: decision datasets, boosted learners with calibration, prediction metrics and verdicts.

Three ways of growing boosted trees stand in for the three boosted libraries of the reference, which Spark does not bundle; all folds,
learners and classes grow together (`boosting`).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.hashing import uniform
from barwright.functions.numeric import count_where, failed_names, ratio
from barwright.operators import boosting
from barwright.operators.conditions import learn_thresholds, threshold_name
from barwright.operators.quantiles import attach
from barwright.session import materialize

CLASSES = ("DOWN", "NO_TRADE", "UP")
DOWN, NO_TRADE, UP = 0, 1, 2
REGIMES = ("RANGE", "TREND_DOWN", "TREND_UP")


# ---- dataset ---------------------------------------------------------------------------------------

def decision_rows(experiences: DataFrame, minute: int, horizon: int, features: Sequence[str], session: str = "session_id") -> DataFrame:
    """One row per session at the decision minute: WAIT state beside LONG and SHORT outcomes (one pivot, no self join)."""
    def of(action: str, column: str) -> Column:
        return F.max(F.when(F.col("action") == action, F.col(column)))
    fields = ("gross", "net", "cost", "mfe", "mae")
    return (experiences.where(F.col("minute") == minute).groupBy("symbol", session).agg(
        of("WAIT", "decision_ts").alias("decision_ts"), of("WAIT", "close").alias("close"), of("WAIT", "state_regime").alias("state_regime"),
        of("LONG", f"cost_method_{horizon}").alias("cost_method"), F.count(F.lit(1)).alias("_actions"),
        *[of("WAIT", f).alias(f) for f in features],
        *[of(a, f"{f}_{horizon}").alias(f"{a.lower()}_{f}") for a in ("LONG", "SHORT") for f in fields])
        .where(F.col("_actions") == 3).drop("_actions"))


def with_target(df: DataFrame, atr_multiple: float) -> DataFrame:
    """UP wins ties; a class needs a net return above a share of the average range."""
    barrier = ratio(F.lit(atr_multiple) * F.col("state_atr"), "close")
    label = F.when(F.col("long_net") > F.col("barrier"), F.lit(UP)).when(F.col("short_net") > F.col("barrier"), F.lit(DOWN)).otherwise(F.lit(NO_TRADE))
    known = F.col("long_net").isNotNull() & F.col("short_net").isNotNull() & F.col("barrier").isNotNull()
    return df.withColumn("barrier", barrier).withColumn("target", F.when(known, label))


def with_auxiliary(df: DataFrame, actions: Sequence[str] = ("long", "short")) -> DataFrame:
    """Whether each side's best excursion clears the range barrier and its cost."""
    return df.withColumns({f"{a}_reaches": (F.col(f"{a}_mfe") > F.col("barrier") + F.col(f"{a}_cost")).cast("int") for a in actions})


def with_regime_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({f"regime_{name}": (F.col("state_regime") == name).cast("double") for name in REGIMES})


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull()
    return df.where(keep)


def dataset_manifest(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Class counts, exclusions and the distinct cost methods of a decision dataset."""
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull()
    usable = complete & F.col("target").isNotNull()
    return df.agg(F.count(F.lit(1)).alias("sessions"), count_where(usable).alias("usable"), count_where(~usable).alias("excluded"),
                  *[count_where(usable & (F.col("target") == i)).alias(f"class_{n.lower()}") for i, n in enumerate(CLASSES)],
                  F.concat_ws(",", F.sort_array(F.collect_set("cost_method"))).alias("cost_methods"))


def impute_median(train: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing features take the exact training median (zero when the feature is absent altogether)."""
    medians = learn_thresholds(train, {(f, 0.5) for f in features})
    filled = attach(df, medians)
    return filled.withColumns({f: F.coalesce(F.col(f), F.col(threshold_name(f, 0.5)), F.lit(0.0)) for f in features}).drop(
        *[threshold_name(f, 0.5) for f in features])


def lagged_features(df: DataFrame, features: Sequence[str], order: str, steps: int, keys: Sequence[str] = ()) -> DataFrame:
    """Features of the session `steps` earlier; a decision dataset has one row per session."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f: F.lag(f, steps).over(w) for f in features})


def permuted_labels(df: DataFrame, label: str, order: str, by: Sequence[str], block: int, seed: int) -> DataFrame:
    """Blocks of consecutive labels dealt in a hashed order within each segment."""
    w = Window.partitionBy(*by).orderBy(order)
    placed = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_i") / block))
    shuffled = placed.select(*by, F.col("_i"), F.col(label).alias("_label"), uniform(F.lit(seed), "_b").alias("_u"))
    dealt = shuffled.withColumn("_j", F.row_number().over(Window.partitionBy(*by).orderBy("_u", "_i")) - 1)
    source = dealt.select(*by, F.col("_j").alias("_i"), F.col("_label"))
    return placed.join(source, [*by, "_i"]).withColumn(label, F.col("_label")).drop("_i", "_b", "_label")


# ---- learners --------------------------------------------------------------------------------------

PART_CODES = {"FIT": boosting.FIT, "STOP": boosting.STOP, "CALIBRATE": 2, "TEST": 3}


def coded_parts(tagged: DataFrame, folds: Sequence[int], run: int = 0, seed: int = 0) -> DataFrame:
    """Rows with group (one per run and fold), part_code and the key that draws rows, from fold, role and part."""
    part = F.when(F.col("role") == "TEST", PART_CODES["TEST"])
    for name, code in PART_CODES.items():
        part = part.when(F.col("part") == name, code)
    place = F.array_position(F.array(*[F.lit(fold) for fold in folds]), F.col("fold")) - 1
    return tagged.withColumns({"group": (run * len(folds) + place).cast("int"), "part_code": part, "draw_key": F.concat_ws(":", F.lit(seed), "id")}).where("part_code IS NOT NULL AND group >= 0")


def imputed(coded: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with missing features filled, medians per group): exact medians of the group's FIT rows, zero where it has none."""
    medians = learn_thresholds(coded.where(F.col("part_code") == PART_CODES["FIT"]), {(f, 0.5) for f in features}, by=["group"])
    filled = coded.join(medians, "group", "left")
    names = {f: threshold_name(f, 0.5) for f in features}
    filled = filled.withColumns({f: F.coalesce(F.col(f), F.col(name), F.lit(0.0)) for f, name in names.items()}).drop(*names.values())
    return filled, medians.select("group", *[F.coalesce(F.col(name), F.lit(0.0)).alias(f) for f, name in names.items()])


def boosted_scores(coded: DataFrame, features: Sequence[str], groups: int, classes: int = 3, keep: Sequence[str] = (), rounds: int = boosting.ROUNDS) -> tuple[DataFrame, boosting.Booster]:
    """Raw class scores of every learner on the CALIBRATE and TEST rows, and the trees. All groups are boosted together."""
    rows, _ = imputed(coded, features)
    rows = materialize(rows)
    booster = boosting.train(rows, features, ["label"], groups, "classes", classes, rounds, key="draw_key")
    later = rows.where(F.col("part_code") >= PART_CODES["CALIBRATE"])
    scored = boosting.predict(later, booster, features, ["id", "label", "fold", "group", "part_code", *keep])
    learner = F.array_position(F.array(*[F.lit(name) for name in boosting.LEARNERS]), F.col("learner")) - 1
    return scored.withColumn("model", (F.col("group") * len(boosting.LEARNERS) + learner).cast("int")), booster


def calibrated_tests(scored: DataFrame, groups: int, classes: int = 3) -> tuple[DataFrame, list]:
    """(TEST rows with calibrated p, calibrators), the calibrators fitted on the CALIBRATE rows of the same model."""
    weights = boosting.calibrators(scored.where(F.col("part_code") == PART_CODES["CALIBRATE"]), groups * len(boosting.LEARNERS), classes)
    return boosting.calibrated(scored.where(F.col("part_code") == PART_CODES["TEST"]), weights), weights


def ensemble(predictions: DataFrame, keys: Sequence[str], classes: int = 3) -> DataFrame:
    """Mean probability and population spread per class over learners."""
    return predictions.groupBy(*keys).agg(
        F.array(*[F.avg(F.col("p")[i]) for i in range(classes)]).alias("p"),
        F.array(*[F.stddev_pop(F.col("p")[i]) for i in range(classes)]).alias("spread"))


def importances(booster: boosting.Booster, features: Sequence[str], folds: Sequence[int], spark) -> DataFrame:
    """Normalised gain per fold, learner and feature: a few numbers per model."""
    share = booster.importance()
    rows = [(int(fold), name, f, float(share[g, l, i])) for g, fold in enumerate(folds) for l, name in enumerate(boosting.LEARNERS) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "fold int, learner string, feature string, importance double")


def rank_stability(table: DataFrame) -> DataFrame:
    """Mean Spearman correlation of importance ranks between consecutive folds (average ranks for ties).

    A fold whose features all share one rank (trees without a split) has no correlation: its pairs are left out, and a learner without any pair has NULL.
    """
    w = Window.partitionBy("fold", "learner").orderBy("importance")
    tied = Window.partitionBy("fold", "learner", "importance")
    ranked = table.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(tied) - 1) / 2)
    before = ranked.select((F.col("fold") + 1).alias("fold"), "learner", "feature", F.col("rank").alias("_before"))
    x, y = F.col("rank"), F.col("_before")
    spread = [F.var_pop(c) for c in (x, y)]
    per = ranked.join(before, ["fold", "learner", "feature"]).groupBy("learner", "fold").agg(F.covar_pop(x, y).alias("_xy"), F.sqrt(spread[0] * spread[1]).alias("_s"))
    per = table.select("learner").distinct().join(per.withColumn("_c", F.when(F.col("_s") > 0, F.try_divide("_xy", "_s"))), "learner", "left")
    return per.groupBy("learner").agg(F.avg("_c").alias("rank_stability"), F.count("_c").alias("fold_pairs"))


def save_model(spark, root: str, booster: boosting.Booster, medians: DataFrame, calibrators, manifest: Mapping[str, object]) -> None:
    """A fitted model as Parquet tables: trees, bins, medians, calibrators and a manifest."""
    trees = [(int(n), int(g), name, int(k), booster.feature[n, g, l, k].tolist(), booster.cut[n, g, l, k].tolist(), booster.leaf[n, g, l, k].tolist())
             for n in range(len(booster.feature)) for g in range(booster.base.shape[0]) for l, name in enumerate(boosting.LEARNERS) for k in range(booster.base.shape[1]) if n < booster.used[g, l]]
    bins = [(int(g), i, edges.tolist()) for g in range(booster.edges.shape[0]) for i, edges in enumerate(booster.edges[g])]
    spark.createDataFrame(trees, "round int, group int, learner string, output int, feature array<int>, cut array<int>, leaf array<double>").write.parquet(f"{root}/trees")
    spark.createDataFrame(bins, "group int, place int, edges array<double>").write.parquet(f"{root}/bins")
    medians.write.parquet(f"{root}/medians")
    spark.createDataFrame([(int(m), row.tolist()) for m, one in enumerate(calibrators) for row in one], "model int, weights array<double>").coalesce(1).write.parquet(f"{root}/calibrators")
    facts = dict(manifest) | {"kind": booster.kind, "base": booster.base.tolist(), "used": booster.used.tolist(), "rounds": boosting.ROUNDS, "depth": boosting.DEPTH, "step": boosting.STEP}
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "manifest string").write.parquet(f"{root}/manifest")


def load_model(spark, root: str) -> boosting.Booster:
    """The trees of `save_model`; what a model is worth reading for (gains and losses of training) is not kept."""
    facts = json.loads(spark.read.parquet(f"{root}/manifest").first()["manifest"])
    base, used = np.array(facts["base"]), np.array(facts["used"])
    bins = spark.read.parquet(f"{root}/bins").collect()
    edges = np.full((base.shape[0], 1 + max(row["place"] for row in bins), boosting.BINS - 1), np.inf)
    for row in bins:
        edges[row["group"], row["place"]] = row["edges"]
    shape = (int(used.max()), base.shape[0], len(boosting.LEARNERS), base.shape[1])
    feature, cut = (np.full((*shape, (1 << facts["depth"]) - 1), fill, np.int64) for fill in (-1, 0))
    leaf = np.zeros((*shape, 1 << facts["depth"]))
    for row in spark.read.parquet(f"{root}/trees").collect():
        at = (row["round"], row["group"], boosting.LEARNERS.index(row["learner"]), row["output"])
        feature[at], cut[at], leaf[at] = row["feature"], row["cut"], row["leaf"]
    return boosting.Booster(facts["kind"], edges, base, feature, cut, leaf, np.zeros((*used.shape, edges.shape[1])), np.zeros((0, *used.shape)), used)


# ---- metrics ---------------------------------------------------------------------------------------

def with_prediction(df: DataFrame, p: str = "p") -> DataFrame:
    """Arg-max class (the first of equals) and its probability."""
    best = F.array_max(p)
    return df.withColumn("confidence", best).withColumn("predicted", (F.array_position(p, best) - 1).cast("int"))


def classification_metrics(df: DataFrame, by: Sequence[str], label: str = "label", classes: int = 3, bins: int = 10) -> DataFrame:
    """Balanced accuracy, log loss, multiclass Brier score and expected calibration error, from two aggregates."""
    scored = with_prediction(df)
    hit = (F.col("predicted") == F.col(label)).cast("double")
    chance = F.element_at("p", (F.col(label) + 1).cast("int"))
    brier = sum(((F.col("p")[i] - (F.col(label) == i).cast("double")) ** 2 for i in range(classes)), F.lit(0.0))
    per_class = [F.avg(F.when(F.col(label) == i, hit)) for i in range(classes)]
    balanced = sum((F.coalesce(c, F.lit(0.0)) for c in per_class), F.lit(0.0)) / sum((c.isNotNull().cast("int") for c in per_class), F.lit(0))
    facts = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), balanced.alias("balanced_accuracy"),
                                    F.avg(-F.log(F.greatest(chance, F.lit(1e-15)))).alias("log_loss"), F.avg(brier).alias("brier"))
    slot = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    cells = scored.groupBy(*by, slot.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.avg(hit).alias("_hit"), F.avg("confidence").alias("_conf"))
    ece = cells.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_hit") - F.col("_conf"))) / F.sum("_n")).alias("ece"))
    return facts.join(ece, list(by))


def economic_decision(df: DataFrame, minimum: float, maximum_spread: float | None = None, multiplier: float = 1.0) -> DataFrame:
    """Trade or abstain per row, with the net return of the chosen side."""
    scored = with_prediction(df)
    trade = (F.col("predicted") != NO_TRADE) & (F.col("confidence") >= minimum)
    if maximum_spread is not None:
        trade = trade & (F.element_at("spread", F.col("predicted") + 1) <= maximum_spread)
    long = F.col("predicted") == UP
    net = F.when(long, F.col("long_gross") - multiplier * F.col("long_cost")).otherwise(F.col("short_gross") - multiplier * F.col("short_cost"))
    return scored.withColumn("trade", trade).withColumn("net", F.when(trade, net).otherwise(F.lit(0.0)))


def economic_summary(decided: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    on = F.col("trade")
    facts = decided.groupBy(*by).agg(
        count_where(on).alias("trades"), F.avg(on.cast("double")).alias("coverage"), F.coalesce(F.avg(F.when(on, F.col("net"))), F.lit(0.0)).alias("mean_net"),
        F.coalesce(F.sum(F.when(on, F.col("net"))), F.lit(0.0)).alias("cumulative_net"), F.coalesce(F.avg(F.when(on, (F.col("net") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"))
    years = decided.groupBy(*by, F.year(time).alias("_y")).agg(F.sum("net").alias("_n")).groupBy(*by).agg(F.avg((F.col("_n") > 0).cast("double")).alias("positive_years"))
    return facts.join(years, list(by))


def class_frequencies(train: DataFrame, label: str = "label", classes: int = 3) -> DataFrame:
    """Base rates of the training labels as one probability array."""
    return train.agg(F.array(*[F.avg((F.col(label) == i).cast("double")) for i in range(classes)]).alias("p"))


def binary_report(df: DataFrame, by: Sequence[str], probability: str, label: str) -> DataFrame:
    """Brier score, log loss and rates of a binary probability."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(label).cast("double")
    return df.groupBy(*by).agg(F.avg((F.col(probability) - y) ** 2).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
                               F.avg(y).alias("observed_rate"), F.avg(probability).alias("mean_probability"))


# Tests of the trained output and their limits: fixed values.
LEAST_YEARS_SHARE, LEAST_GAIN, MOST_ECE = 0.75, 0.02, 0.10


def skeptic_tests(facts: DataFrame, maximum_spread: float) -> DataFrame:
    """Names of the tests that fail, from per-scope facts: ci_low of the mean traded return, positive_share of the periods, cost_2x_mean,
    after_best_removed, balanced_accuracy beside shifted_accuracy, ece, mean_spread, and block_low, the low end of the block bootstrap of all days."""
    checks = [("bootstrap_ci_lower_positive", F.col("ci_low") > 0), ("positive_in_at_least_75pct_periods", F.col("positive_share") >= LEAST_YEARS_SHARE), ("survives_cost_2x", F.col("cost_2x_mean") > 0),
              ("survives_remove_best_5pct", F.col("after_best_removed") > 0), ("beats_label_shift", F.col("balanced_accuracy") > F.col("shifted_accuracy") + LEAST_GAIN), ("calibration_ece", F.col("ece") <= MOST_ECE),
              ("mean_spread", F.col("mean_spread") <= maximum_spread), ("block_bootstrap_positive", F.col("block_low") > 0)]
    return facts.withColumn("failed_tests", failed_names(checks)).withColumn("skeptic_survived", F.size("failed_tests") == 0)


def promotion_verdict(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """REJECTED unless predictive and economic gates hold; RESEARCH_ONLY unless the skeptic and real costs agree."""
    predictive = (F.col("balanced_accuracy") >= thresholds["balanced_accuracy"]) & (F.col("log_loss") < F.col("baseline_log_loss"))
    economic = (F.col("mean_net") > 0) & (F.col("trades") >= thresholds["trades"])
    return df.withColumn("verdict", F.when(~(predictive & economic), F.lit("REJECTED"))
                         .when(~(F.col("skeptic_survived") & F.col("real_costs")), F.lit("RESEARCH_ONLY")).otherwise(F.lit("VALIDATION_READY")))
