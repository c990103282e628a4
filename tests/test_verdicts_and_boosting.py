"""Verdict rules on rows that meet every outcome, resampling by coin matrices, opportunity bit sets, boosting of many models."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import boosting, conditions as C, evidence as V, learning as L, quantiles, resampling as R, stability as S
from barwright.plans import opportunities as O

GOOD = {"effect": 0.02, "adjusted_p": 0.01, "temporal_favourable": 0.9, "parameter_favourable": 1.0, "controls_passed": True, "support_passed": True, "bootstrap_favourable": 0.99, "cost_favourable": 1.0,
        "skeptic_survival": 1.0, "sessions": 300.0, "quality_ok": True}


@pytest.mark.parametrize("change, reason", [({}, ""), ({"effect": -0.02}, "effect_direction_failed"), ({"effect": 0.001}, "economic_materiality_failed"), ({"adjusted_p": 0.2}, "multiple_testing_failed"),
                                            ({"temporal_favourable": 0.5}, "temporal_stability_failed"), ({"parameter_favourable": 0.5}, "parameter_stability_failed"), ({"controls_passed": False}, "negative_control_failed"),
                                            ({"support_passed": False}, "minimum_support_failed")])
def test_each_reason_rejects(spark, change, reason):
    row = S.evidence_score(spark.createDataFrame([GOOD | change]), F.lit(0.01)).first()
    assert ",".join(row["rejection_reasons"]) == reason and row["verdict"] == ("REJECTED" if reason else "DEV_SURVIVOR")


@pytest.mark.parametrize("change", [{"bootstrap_favourable": 0.8}, {"skeptic_survival": 0.6}, {"sessions": 40.0}])
def test_survival_needs_more_than_no_reason(spark, change):
    row = S.evidence_score(spark.createDataFrame([GOOD | change]), F.lit(0.01)).first()
    assert not row["rejection_reasons"] and row["verdict"] == "REJECTED"


FROZEN = {"effect": 0.02, "ci95_low": 0.01, "holm_p": 0.01, "favourable": 0.99, "sign_stability": 0.99, "condition_rows": 6000, "condition_sessions": 250, "condition_years": 3, "temporal_favourable": 0.9, "year_concentration": 0.4,
          "skeptic_survival": 0.9, "slow_passed": True, "net_return": 0.01}


@pytest.mark.parametrize("change, failed, verdict", [({}, "", "VALIDATED_ECONOMIC_CANDIDATE"), ({"net_return": -0.01}, "", "VALIDATED_PREDICTIVE_RELATIONSHIP_NO_TRADE"), ({"effect": -0.1}, "same_direction", "VALIDATION_FAILED"),
                                                     ({"ci95_low": 0.0}, "ci95_directional", "VALIDATION_FAILED"), ({"holm_p": 0.06}, "holm", "VALIDATION_FAILED"), ({"condition_rows": 4999}, "support", "VALIDATION_FAILED"),
                                                     ({"temporal_favourable": 0.5}, "temporal", "VALIDATION_FAILED"), ({"year_concentration": 0.7}, "not_year_concentrated", "VALIDATION_FAILED"), ({"skeptic_survival": 0.7}, "skeptic", "VALIDATION_FAILED"),
                                                     ({"slow_passed": False}, "slow_structure", "VALIDATION_FAILED")])
def test_confirmation_gates(spark, change, failed, verdict):
    row = S.confirmation_verdict(spark.createDataFrame([FROZEN | change])).first()
    assert (",".join(row["failed_checks"]), row["verdict"]) == (failed, verdict)


def test_evidence_of_planted_effects_in_both_directions(spark):
    """A rise, a fall and nothing, under the same condition: LESS makes the fall favourable."""
    rng = random.Random(2)
    rows = []
    for day in range(60):
        for minute in range(12):
            high = rng.random() < 0.4
            noise = rng.gauss(0, 0.2)
            rows.append((f"2020-01-{day:03d}", minute, 1.0 if high else 0.0, noise + high, noise - high, rng.gauss(0, 1), 1.0))
    frame = spark.createDataFrame(rows, "session_id string, minute int, x double, up double, down double, none double, price double")
    told = [{"id": name, "family": "F", "condition": {"type": "fixed_gte", "field": "x", "value": 0.5}, "target": target, "action": "WAIT", "direction": direction, "neighbours": (), "minimum_effect": 0.01}
            for name, target, direction in (("RISE", "up", "GREATER"), ("FALL", "down", "LESS"), ("AGAINST", "down", "GREATER"), ("NOTHING", "none", "GREATER"))]
    table = V.sums(V.late_outcomes(frame, ["up", "down", "none"], ["minute"]), told)
    found = {r["hypothesis"]: r for r in V.facts(table, told, [F.lit("2020")], F.lit("2020"), frame.agg((F.count_if(F.col("price") <= 0) > 0)), 200, 200).collect()}
    per = {}
    for session, _, x, up, *_ in rows:
        per.setdefault(session, ([], []))[0 if x else 1].append(up)
    pairs = [np.mean(a) - np.mean(b) for a, b in per.values() if a and b]
    assert found["RISE"]["effect"] == pytest.approx(np.mean(pairs)) and found["FALL"]["effect"] == pytest.approx(np.mean(pairs), abs=0.2)
    for name, good in (("RISE", True), ("FALL", True), ("AGAINST", False)):
        assert (found[name]["bootstrap_favourable"] > 0.99) == good and (found[name]["p_value"] < 0.02) == good and (found[name]["skeptic_survival"] > 0.9) == good
    assert found["RISE"]["condition_sessions"] == sum(bool(a) for a, _ in per.values()) and not found["NOTHING"]["controls_passed"] or found["NOTHING"]["p_value"] > 0.001


def test_row_flips_equal_single_coins(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i * 7, rng.gauss(0.05, 1)) for i in range(400)]
    frame = spark.createDataFrame(rows, "hypothesis string, pos bigint, effect double").repartition(3)
    found = {r["hypothesis"]: r for r in R.sign_flip_rows(frame.where("hypothesis IS NOT NULL"), ["hypothesis"], 300, "W").collect()}
    for name in ("a", "b"):
        own = [(pos, effect) for group, pos, effect in rows if group == name]
        words = {(pos, b): [int.from_bytes(hashlib.md5(f"W:{b}:{pos}".encode()).digest()[4 * w:4 * w + 4], "big") for w in range(4)] for pos, _ in own for b in range(3)}
        means = [np.mean([-e if words[pos, r // 128][r % 128 // 32] >> (r % 32) & 1 else e for pos, e in own]) for r in range(300)]
        observed = np.mean([e for _, e in own])
        assert found[name]["p_value"] == pytest.approx((sum(m >= observed - 1e-12 for m in means) + 1) / 301) and found[name]["null_median"] == pytest.approx(np.median(means))


def test_only_asked_quantiles_are_computed(spark):
    rows = spark.createDataFrame([(i / 7, float(i % 13)) for i in range(200)], "a double, b double")
    found = C.learn_thresholds(rows, {("a", 0.5), ("b", 0.25)}).first()
    assert found["a__q500"] == pytest.approx(np.quantile([i / 7 for i in range(200)], 0.5)) and found["b__q250"] == pytest.approx(np.quantile([i % 13 for i in range(200)], 0.25))
    assert quantiles.attach(rows, rows.limit(0).select("a").withColumnRenamed("a", "z")).first()["z"] is None


def test_bit_sets_spread_to_their_hypotheses(spark):
    rows = spark.createDataFrame([(1 << 0 | 1 << 29, 1 << 5, 0, 1996, "d", "RANGE", 0.01, 0.0, 0.005, 0.02, 0.03, 0.04), (0, 0, 0, 1996, "d", "RANGE", 0.01, 0.0, 0.0, 0.0, 0.0, 0.0)],
                                 "chosen bigint, weaker bigint, stronger bigint, fold int, session_id string, state_regime string, cost double, g double, size_5 double, size_15 double, size_30 double, size_60 double").withColumn("ts", F.current_date())
    found = {r["hypothesis"]: r for r in O.spread(rows, ("chosen", "weaker", "stronger")).collect()}
    assert set(found) == {"OPP-01", "OPP-06", "OPP-30"} and found["OPP-06"]["is_weaker"] and not found["OPP-06"]["is_chosen"]
    # OPP-01: 15 minutes, twice the cost; OPP-30: 30 minutes, three times.
    assert (found["OPP-01"]["mx"], found["OPP-01"]["large"], found["OPP-01"]["reach"]) == (0.02, True, 15) and (found["OPP-30"]["mx"], found["OPP-30"]["large"], found["OPP-30"]["reach"]) == (0.03, True, 30)


def boosted_rows(spark, count=900):
    rng = random.Random(4)
    rows = []
    for group in range(2):
        for i in range(count):
            x, y = rng.random(), rng.random()
            # Group 0 has a pattern, group 1 none.
            label = (0 if x < 0.3 else 2 if y > 0.6 else 1) if group == 0 else rng.randrange(3)
            rows.append((f"{group}-{i}", group, [0, 0, 0, 1, 2][i % 5], x, y, label, x - y))
    return spark.createDataFrame(rows, "id string, group int, part_code int, x double, y double, label int, z double").repartition(3)


def test_boosting_learns_where_there_is_something_and_stops_where_there_is_nothing(spark):
    rows = boosted_rows(spark)
    booster = boosting.train(rows, ["x", "y"], ["label"], 2, "classes", 3, rounds=60)
    assert (booster.loss[0, 0] > booster.loss[-1, 0] + 0.3).all() and (booster.used[0] > 40).all() and (booster.used[1] < 40).all()
    scored = boosting.predict(rows.where("part_code = 2"), booster, ["x", "y"], ["id", "group", "label"]).collect()
    assert len(scored) == 2 * 180 * 3 and all(sum(r["score"]) == pytest.approx(1) for r in scored)
    for name in boosting.LEARNERS:
        own = [r for r in scored if r["learner"] == name and r["group"] == 0]
        assert np.mean([int(np.argmax(r["score"])) == r["label"] for r in own]) > 0.95
    # The symmetric learner has one split per level.
    same = booster.feature[:, 0, boosting.LEARNERS.index("symmetric")]
    assert all(len(set(zip(same[n, k, 1:3].tolist(), booster.cut[n, 0, 2, k, 1:3].tolist()))) == 1 for n in range(10) for k in range(3))


def test_boosting_of_targets_and_calibration(spark):
    rows = boosted_rows(spark)
    booster = boosting.train(rows, ["x", "y"], ["z", "x"], 2, "targets", rounds=80)
    found = boosting.predict(rows.where("part_code = 2"), booster, ["x", "y"], ["z", "x"]).collect()
    assert np.mean([abs(r["score"][0] - r["z"]) for r in found]) < 0.12 and np.mean([abs(r["score"][1] - r["x"]) for r in found]) < 0.08
    rng = random.Random(1)
    raw = []
    for i in range(2000):
        p = rng.random()
        raw.append((i % 2, [1 - p, p], int(rng.random() < (p if i % 2 == 0 else 1 - p))))
    table = spark.createDataFrame(raw, "model int, score array<double>, label int")
    weights = boosting.calibrators(table, 3, 2)
    out = boosting.calibrated(table.union(spark.createDataFrame([(2, [0.1, 0.9], 0)], table.schema)), weights).collect()
    assert all(sum(r["p"]) == pytest.approx(1) for r in out)
    upper = [r for r in out if r["score"][1] > 0.9 and r["model"] < 2]
    assert np.mean([r["p"][1] for r in upper if r["model"] == 0]) > 0.75 and np.mean([r["p"][1] for r in upper if r["model"] == 1]) < 0.25
    assert out[-1]["p"] == pytest.approx([0.5, 0.5])


@pytest.mark.parametrize("method", ["BH", "HOLM"])
def test_adjusted_p_of_a_hot_family_with_ties(spark, method):
    rng = random.Random(7)
    rows = [(i, "hot", rng.choice([0.0, 1.0, 0.5, 1e-9, rng.random(), rng.random() ** 8])) for i in range(1500)] + [(5000 + i, "small", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.04])] + [(9000, "hot", None)]
    found = {r["id"]: r["q"] for r in R.adjusted_scan(spark.createDataFrame(rows, "id bigint, family string, p double"), "p", ["family"], "id", method, "q").collect()}
    assert len(found) == len(rows) and found[9000] is None
    for family in ("hot", "small"):
        own = sorted((p, i) for i, f, p in rows if f == family and p is not None)
        n, best = len(own), (1.0 if method == "BH" else 0.0)
        for place in (range(n, 0, -1) if method == "BH" else range(1, n + 1)):
            p, i = own[place - 1]
            best = min(best, p * n / place) if method == "BH" else max(best, p * (n - place + 1))
            assert found[i] == pytest.approx(min(1.0, best))


SOUND = {"balanced_accuracy": 0.5, "log_loss": 0.9, "baseline_log_loss": 1.0, "mean_net": 0.01, "trades": 50, "real_costs": True, "ci_low": 0.001, "positive_share": 0.8, "cost_2x_mean": 0.001, "after_best_removed": 0.001,
         "shifted_accuracy": 0.34, "ece": 0.05, "mean_spread": 0.05, "block_low": 0.001}


@pytest.mark.parametrize("change, failed, verdict", [({}, "", "VALIDATION_READY"), ({"real_costs": False}, "", "RESEARCH_ONLY"), ({"ci_low": -0.1}, "bootstrap_ci_lower_positive", "RESEARCH_ONLY"), ({"positive_share": 0.7}, "positive_in_at_least_75pct_periods", "RESEARCH_ONLY"),
                                                     ({"cost_2x_mean": 0.0}, "survives_cost_2x", "RESEARCH_ONLY"), ({"after_best_removed": -1.0}, "survives_remove_best_5pct", "RESEARCH_ONLY"), ({"shifted_accuracy": 0.49}, "beats_label_shift", "RESEARCH_ONLY"),
                                                     ({"ece": 0.2}, "calibration_ece", "RESEARCH_ONLY"), ({"mean_spread": 0.3}, "mean_spread", "RESEARCH_ONLY"), ({"block_low": 0.0}, "block_bootstrap_positive", "RESEARCH_ONLY"),
                                                     ({"balanced_accuracy": 0.33, "shifted_accuracy": 0.1}, "", "REJECTED"), ({"log_loss": 1.1}, "", "REJECTED"), ({"mean_net": 0.0}, "", "REJECTED"), ({"trades": 9}, "", "REJECTED")])
def test_promotion_gates(spark, change, failed, verdict):
    row = L.promotion_verdict(L.skeptic_tests(spark.createDataFrame([SOUND | change]), 0.1), {"balanced_accuracy": 0.34, "trades": 10}).first()
    assert (",".join(row["failed_tests"]), row["verdict"]) == (failed, verdict)
