"""Ordered windows, quantiles, as-of lookups and hashing against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from barwright.functions.clock import local_to_utc
from barwright.functions.numeric import failed_names, normal_cdf, p_positive, rounded
from barwright.operators.asof import forward_asof, next_tick
from barwright.operators.quantiles import exact_quantiles
from barwright.operators.sequence import (CORE, balanced_chunk, carry_forward, chunk_window, core_rows, islands, running_count, salted_join,
                                          with_index_halo, with_row_halo)


def series(spark, n=300, seed=3):
    rng = random.Random(seed)
    index, rows = 0, []
    for i in range(n):
        index += 1 if rng.random() < 0.9 else rng.randint(2, 40)
        rows.append(("A" if i % 7 else "B", index, float(rng.randint(1, 5)), i))
    return spark.createDataFrame(rows, "symbol string, bar_index long, close double, id long")


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_index_halo_equals_global_window(spark):
    df = series(spark)
    w = Window.partitionBy("symbol").orderBy("bar_index")
    exact = F.col("bar_index") - F.lag("bar_index", 3).over(w) == 3
    want = values(df.withColumn("x", F.when(exact, F.lag("close", 3).over(w))), "id", "x")
    cw = chunk_window(["symbol"], ["bar_index"])
    halo = with_index_halo(df, "bar_index", 16, 5, 5)
    exact = F.col("bar_index") - F.lag("bar_index", 3).over(cw) == 3
    got = values(core_rows(halo.withColumn("x", F.when(exact, F.lag("close", 3).over(cw)))), "id", "x")
    assert got == want


@pytest.mark.parametrize("ahead", [False, True])
def test_row_halo_crosses_gaps_of_any_length(spark, ahead):
    df = series(spark)
    w, cw = Window.partitionBy("symbol").orderBy("bar_index"), chunk_window(["symbol"], ["bar_index"])
    move = F.lead if ahead else F.lag
    want = values(df.withColumn("x", move("close", 4).over(w)), "id", "x")
    halo = with_row_halo(df, ["symbol"], ["bar_index"], F.floor(F.col("bar_index") / 7), 4, ["close"], ahead=ahead)
    got = values(halo.withColumn("x", move("close", 4).over(cw)).where(CORE), "id", "x")
    assert got == want


def test_carry_islands_and_count(spark):
    df = series(spark)
    chunk = F.floor(F.col("bar_index") / 11)
    w = Window.partitionBy("symbol").orderBy("bar_index")
    mark = F.when(F.col("close") == 1, F.col("bar_index"))
    want = values(df.withColumn("x", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))), "id", "x")
    assert values(carry_forward(df, ["symbol"], ["bar_index"], chunk, mark, "x"), "id", "x") == want
    assert values(islands(df, ["symbol"], ["bar_index"], chunk, F.col("close") == 1, "x"), "id", "x") == want
    want = values(df.withColumn("n", F.row_number().over(w)), "id", "n")
    assert values(running_count(df, ["symbol"], ["bar_index"], chunk, "n"), "id", "n") == want


def test_balanced_chunk_keeps_order_with_a_hot_instant(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("A", base + dt.timedelta(minutes=i), i) for i in range(50)]
    rows += [("A", base + dt.timedelta(minutes=20), 1000 + i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long")
    placed = balanced_chunk(df, ["k"], "ts", "id", 60_000_000, target=25)
    got = [tuple(r[:2]) for r in placed.orderBy("_slab", "ts", "id").select("ts", "id").collect()]
    assert got == sorted((r[1], r[2]) for r in rows)
    sizes = [r["count"] for r in placed.groupBy("_slab").count().collect()]
    assert max(sizes) <= 50 and len(sizes) > 4


def test_salted_join_matches_plain_join(spark):
    rows = spark.range(500).withColumn("k", F.when(F.col("id") < 350, 1).otherwise(F.col("id") % 5))
    groups = spark.createDataFrame([(1, "a"), (3, "b")], "k long, v string")
    assert values(salted_join(rows, groups, ["k"], "id", salts=4), "id", "v") == values(rows.join(groups, "k", "left"), "id", "v")


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "signed", "single"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(7)
    data = {"uniform": rng.random(999), "heavy": np.exp(rng.normal(0, 6, 800)), "ties": rng.integers(0, 4, 777).astype(float),
            "signed": np.concatenate([rng.normal(0, 1e-6, 300), -np.exp(rng.normal(0, 3, 300)), np.zeros(50)]), "single": np.array([3.5])}[kind]
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate(data)], "v double, g int")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs).first()
    assert np.allclose(list(got), np.quantile(data, probs), rtol=1e-12, atol=0)
    for row in exact_quantiles(df, "v", probs, by=["g"]).collect():
        assert np.allclose(list(row)[1:], np.quantile(data[row["g"]::2], probs), rtol=1e-12, atol=0)


def test_quantiles_over_nested_folds(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=600)
    df = spark.createDataFrame([(float(x), [f for f in (1, 2, 3) if i < 200 * f]) for i, x in enumerate(data)], "v double, folds array<int>")
    for row in exact_quantiles(df, "v", [0.25, 0.9], fan="folds").collect():
        assert np.allclose([row["q250"], row["q900"]], np.quantile(data[:200 * row["fold"]], [0.25, 0.9]), rtol=1e-12)


def test_golden_threshold(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert exact_quantiles(df, "x", [0.75]).first()[0] == 3.25


@pytest.mark.parametrize("tolerance", [1, 60])
def test_forward_asof_against_brute_force(spark, tolerance):
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    ticks = sorted(base + dt.timedelta(milliseconds=rng.randint(0, 900_000)) for _ in range(400)) + [base + dt.timedelta(seconds=300)] * 30
    targets = [base + dt.timedelta(milliseconds=rng.randint(0, 960_000)) for _ in range(200)] + [base + dt.timedelta(seconds=300)]
    tdf = spark.createDataFrame([("A", t, float(i), i) for i, t in enumerate(ticks)], "k string, ts timestamp, bid double, id long")
    qdf = spark.createDataFrame([("A", t) for t in targets], "k string, at timestamp")
    got = {r["at"]: r["quote_ts"] for r in forward_asof(qdf, tdf, ["k"], "at", "ts", "id", ["bid"], tolerance * 1_000_000).collect()}
    later = {r["at"]: r["bid"] for r in next_tick(qdf, tdf, ["k"], "at", "ts", "id", ["bid"], 30_000_000).collect()}
    first = {}
    for i, t in enumerate(ticks):
        first.setdefault(t, float(i))
    for t in set(targets):
        after = [x for x in ticks if x >= t]
        best = min(after) if after else None
        assert got[t] == (best if best is not None and best - t <= dt.timedelta(seconds=tolerance) else None)
        assert later[t] == (first[best] if best is not None else None)


def test_local_clock_guard(spark):
    rows = [("2024-11-03 01:30:00", "AMBIGUOUS"), ("2024-03-10 02:30:00", "NONEXISTENT"), ("2024-07-01 12:00:00", None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("t", F.col("t").cast("timestamp"))
    utc, problem = local_to_utc("t", "America/New_York")
    assert all(r["p"] == r["want"] for r in df.select(problem.alias("p"), "want").collect())


def test_numeric_expressions(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.0)).alias("a"), normal_cdf(F.lit(-1.96)).alias("b"), p_positive(F.lit(0.1), F.lit(0.0)).alias("c"),
                                p_positive(F.lit(None).cast("double"), F.lit(1.0)).alias("d"), rounded(F.lit(-1e-9)).alias("z"),
                                failed_names([("x", F.lit(True)), ("y", F.lit(False)), ("n", F.lit(None).cast("boolean"))]).alias("f")).first()
    assert abs(row["a"] - 0.8413447) < 1e-6 and abs(row["b"] - 0.0249979) < 1e-6
    assert (row["c"], row["d"]) == (0.0, 1.0) and math.copysign(1, row["z"]) == 1.0 and row["f"] == ["y", "n"]


def test_source_rows_over_several_files(spark, tmp_path):
    from barwright.sources.files import source_rows
    rows = [(i, i * 7 % 13) for i in range(1000)]
    for part in range(4):
        spark.createDataFrame(rows[part * 250:(part + 1) * 250], "id long, v long").coalesce(1).write.parquet(str(tmp_path / f"t/part={part}"))
    got = source_rows(spark.read.parquet(str(tmp_path / "t"))).select("source_row", "id").collect()
    assert sorted((r["source_row"], r["id"]) for r in got) == [(i, i) for i in range(1000)]


def test_publish_replaces_what_a_failed_write_left(spark, tmp_path):
    from barwright.sources import sinks
    path, df = str(tmp_path / "out"), spark.range(50).withColumn("k", F.col("id") % 3)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "part-half.parquet").write_bytes(b"half")
    assert sinks.publish(df, path, ["k"]) == "PUBLISHED" and sinks.publish(df.orderBy(F.desc("id")), path, ["k"]) == "UNCHANGED"
    assert spark.read.parquet(path).count() == 50
    with pytest.raises(sinks.PublishConflict):
        sinks.publish(df.limit(49), path, ["k"])
