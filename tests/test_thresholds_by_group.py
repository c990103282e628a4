"""Thresholds by a key that is called `group`, as the folds of training are."""

from barwright.operators import conditions as C, learning as L


def test_the_key_of_thresholds_may_be_called_group(spark):
    rows = spark.createDataFrame([(0, "s", 1.0, 5.0), (0, "s", 3.0, None), (1, "s", 10.0, 7.0)], "group int, s string, a double, b double")
    found = C.learn_thresholds(rows, {("a", 0.5), ("b", 0.5)}, by=["group", "s"]).collect()
    assert {(r["group"], r["s"], r[C.threshold_name("a", 0.5)], r[C.threshold_name("b", 0.5)]) for r in found} == {(0, "s", 2.0, 5.0), (1, "s", 10.0, 7.0)}


def test_missing_features_take_the_median_of_their_group(spark):
    fit = L.PART_CODES["FIT"]
    rows = spark.createDataFrame([(0, fit, 1.0), (0, fit, 4.0), (0, L.PART_CODES["TEST"], None), (1, fit, 9.0), (1, fit, None), (2, fit, None)], "group int, part_code int, a double")
    filled, medians = L.imputed(rows, ["a"])
    assert sorted((r["group"], r["a"]) for r in filled.collect()) == [(0, 1.0), (0, 2.5), (0, 4.0), (1, 9.0), (1, 9.0), (2, 0.0)]
    assert {(r["group"], r["a"]) for r in medians.collect()} == {(0, 2.5), (1, 9.0)}
