"""Sums and quantiles of overlapping groups, taken from columns and bit sets, against the plain forms that make a row per group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import conditions as C
from barwright.operators.quantiles import column_quantiles
from barwright.operators.tallies import tallies
from barwright.plans import opportunities as O

SIZES = [f"size_{h}" for h in O.REACH]


def chosen_rows(count):
    rng = random.Random(7)
    out = []
    for i in range(count):
        base = None if i % 97 == 0 else rng.choice([0.0, rng.random() / 20, -0.0])
        bits = [rng.getrandbits(30) for _ in range(3)]
        out.append((*bits, 1996 + i % 2, f"{1996 + i % 2}-01-{i % 5:02d}", rng.choice(["RANGE", "TREND_UP"]), rng.random() / 100, 0.0, *[None if base is None else share * base for share in O.REACH.values()]))
    return out


class Held:
    """Tables of one stored bit set."""

    def __init__(self, spark, rows):
        self.spark, self.rows = spark, rows

    def stored(self, name, build, partition_by=()):
        return self.rows if name == "opportunity_rows" else build()


def test_sums_of_bit_sets_equal_those_of_spread_rows(spark):
    kinds = "chosen bigint, weaker bigint, stronger bigint, fold int, session_id string, state_regime string, cost double, g double, " + ", ".join(f"{s} double" for s in SIZES)
    rows = spark.createDataFrame(chosen_rows(700), kinds).withColumn("ts", F.current_date()).repartition(3).cache()
    by = ["hypothesis", "fold", "session_id", "state_regime"]
    found = {tuple(r[k] for k in by): r for r in O.sums(Held(spark, rows)).collect()}
    on = F.col("is_chosen")
    plain = O.spread(rows, ("chosen", "weaker", "stronger")).groupBy(*by).agg(
        F.count_if(on).alias("n"), F.count_if(on & F.col("large")).alias("hits"), *[F.sum(F.when(on, F.col(c))).alias(f"sum_{c}") for c in ("mx", "cost", "surplus")], F.count_if("is_weaker").alias("weaker_n"),
        F.sum(F.when(F.col("is_stronger"), F.col("surplus"))).alias("stronger_sum"), *[F.count_if(on & (F.col("reach") == h)).alias(f"reach_{h}") for h in O.REACH]).collect()
    assert len(plain) == len(found) > 300
    for row in plain:
        other = found[tuple(row[k] for k in by)]
        for c in ("n", "hits", "weaker_n", *O.REACHED):
            assert row[c] == other[c], c
        for c in ("sum_mx", "sum_cost", "sum_surplus", "stronger_sum"):
            assert (row[c] or 0.0) == pytest.approx(other[c], abs=1e-12), c


def test_column_quantiles_of_bits_keys_and_folds(spark):
    rng = random.Random(8)
    data = [(rng.choice(["A", "B", None]), sorted(rng.sample([1996, 1997, 1998], rng.randrange(4))), rng.getrandbits(2), rng.choice([None, 0.0, -0.0, rng.gauss(0, 1), -2.5, rng.random() * 1e-9]), float(rng.randrange(5))) for _ in range(900)]
    rows = spark.createDataFrame(data, "k string, folds array<int>, bits bigint, x double, y double").repartition(3)
    probs = [0.1, 0.5, 0.99]
    groups = [("x0", "x", 0), ("x1", "x", 1), ("all", "y", None)]
    found = column_quantiles(rows, groups, probs, [(g, n) for g, *_ in groups for n in range(3)], by=["k"], bits="bits", fan="folds").collect()
    assert len(found) == 3 * 3 * 3
    for row in found:
        column, bit = {"x0": (3, 0), "x1": (3, 1), "all": (4, None)}[row["group"]]
        own = [r[column] for r in data if r[0] == row["k"] and row["fold"] in r[1] and r[column] is not None and (bit is None or r[2] >> bit & 1)]
        assert [row["q100"], row["q500"], row["q990"]] == pytest.approx(list(np.quantile(own, probs)), abs=1e-15)


def test_bit_sets_equal_conditions(spark):
    rng = random.Random(9)
    specs = [{"type": "quantile_gte", "field": "x", "quantile": 0.5}, {"type": "all", "clauses": [{"type": "quantile_lte", "field": "x", "quantile": 0.5}, {"type": "minute_range", "field": "minute", "start": 10, "end": 260}]}]
    rows = spark.createDataFrame([(1996 + i % 3, rng.choice([None, 0.2, 0.4, 0.6, 0.8]), rng.randrange(271)) for i in range(300)], "fold int, x double, minute bigint")
    limits = {1996: {"x__q450": 0.2, "x__q500": 0.4, "x__q550": 0.6}, 1997: {"x__q450": 0.4, "x__q500": 0.6, "x__q550": 0.8}, 1998: {"x__q450": None, "x__q500": None, "x__q550": None}}
    names = {"chosen": 0, "weaker": -1, "stronger": 1}
    found = C.bit_sets(rows, ["fold", "x", "minute"], specs, {name: (n, limits) for name, n in names.items()}, "fold")
    table = spark.createDataFrame([(fold, *row.values()) for fold, row in limits.items()], "fold int, x__q450 double, x__q500 double, x__q550 double")
    plain = found.join(table, "fold")
    wrong = [(F.getbit(name, F.lit(i)) == 1) != C.condition(spec, n) for name, n in names.items() for i, spec in enumerate(specs)]
    assert plain.count() == 300 and plain.where(wrong[0] | wrong[1] | wrong[2] | wrong[3] | wrong[4] | wrong[5]).count() == 0


def test_tallies_skip_missing_values_and_keep_missing_keys(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", None)], "k string, x double").repartition(2)

    def measure(c, i):
        yield slice(None), {"n": None, "known": c["x"] == c["x"], "s": (i + 1) * c["x"]}
    found = {(r["k"], r["g"]): (r["n"], r["known"], r["s"]) for r in tallies(rows, ["k"], ["one", "two"], ["n", "known"], ["s"], measure, "g").collect()}
    assert found == {("a", "one"): (2, 1, 1.0), ("a", "two"): (2, 1, 2.0), (None, "one"): (1, 1, 2.0), (None, "two"): (1, 1, 4.0), ("b", "one"): (1, 0, 0.0), ("b", "two"): (1, 0, 0.0)}
