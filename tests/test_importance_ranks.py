"""Rank stability where folds have no ranking: trees without a split give every feature the same importance."""

import pytest

from barwright.operators import learning as L


def test_folds_without_splits_have_no_correlation(spark):
    table = {"mixed": [(0.0, 0.0, 0.0), (0.2, 0.3, 0.5), (0.5, 0.3, 0.2), (0.5, 0.25, 0.25)], "none": [(0.0, 0.0, 0.0)] * 4}
    rows = [(fold, name, feature, share) for name, folds in table.items() for fold, shares in enumerate(folds) for feature, share in zip("xyz", shares)]
    found = {r["learner"]: r for r in L.rank_stability(spark.createDataFrame(rows, "fold int, learner string, feature string, importance double")).collect()}
    assert found["mixed"]["fold_pairs"] == 2 and found["mixed"]["rank_stability"] == pytest.approx((-1 + 1.5 / 3 ** 0.5) / 2)
    assert found["none"]["fold_pairs"] == 0 and found["none"]["rank_stability"] is None
