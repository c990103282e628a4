"""Boosting: the splits of a level are chosen where the sums meet, so what reaches the driver does not grow with the partitions."""

import pickle

import numpy as np
import pytest
from pyspark import RDD

from barwright.operators import boosting


def rows(spark, partitions):
    rng = np.random.default_rng(5)
    table = [(f"{i}", int(i % 3), int(i % 4 == 3), float(x), float(y), int(x + 0.3 * y > 0.6) + int(y > 0.8)) for i, (x, y) in enumerate(rng.random((1200, 2)))]
    # Group 3 has no rows at all.
    return spark.createDataFrame(table, "id string, group int, part_code int, x double, y double, label int").repartition(partitions, "id")


def test_driver_sees_splits_alone_and_partitions_change_nothing(spark, monkeypatch):
    collected, collect = [], RDD.collect

    def counted(self):
        found = collect(self)
        collected.append(len(pickle.dumps(found)))
        return found
    monkeypatch.setattr(RDD, "collect", counted)
    few = boosting.train(rows(spark, 1), ["x", "y"], ["label"], 4, "classes", 3, rounds=4)
    once, _ = list(collected), collected.clear()
    many = boosting.train(rows(spark, 7), ["x", "y"], ["label"], 4, "classes", 3, rounds=4)
    # Histograms of one partition alone would be 147,456 bytes at the third level.
    assert max(once) < 40_000 and max(collected) < 40_000 and sum(collected) <= 1.05 * sum(once)
    assert (few.feature == many.feature).all() and (few.cut == many.cut).all() and few.loss == pytest.approx(many.loss)
    assert (few.feature[:, 3] == -1).all() and (few.leaf[:, 3] == 0).all()
