"""Statistical golden values, walk-forward rules, scope algebra, custody and streaming equivalence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.operators import conditions as C, custody as S, effects as E, knowledge as K, learning as L, resampling as R, retrieval as V, scope as A, walkforward as W
from barwright.streaming import capture


def test_benjamini_hochberg_and_holm(spark):
    df = spark.createDataFrame([("a", 0.01, 1), ("b", 0.04, 1), ("c", 0.03, 1)], "id string, p double, f int")
    q = {r["id"]: round(r["q_value"], 9) for r in R.benjamini_hochberg(df, "p", ["f"], "id").collect()}
    h = {r["id"]: round(r["holm_p"], 9) for r in R.holm(df, "p", ["f"], "id").collect()}
    assert q == {"a": 0.03, "b": 0.04, "c": 0.04} and h == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_sign_flip_detects_a_shift(spark):
    rows = [("h", f"{i:03d}", -0.01 + 0.04 * i / 99) for i in range(100)]
    placed = R.positions(spark.createDataFrame(rows, "hypothesis string, session_id string, effect double"), ["hypothesis"], ["session_id"])
    got = R.sign_flip_test(placed, ["hypothesis"], 400, F.lit("s")).first()
    assert got["p_value"] < 0.05
    boot = R.session_bootstrap(placed, ["hypothesis"], 300, F.lit("s"))
    block = R.block_bootstrap(placed, ["hypothesis"], 300, F.lit("s"), R.block_size(F.col("n")))
    station = R.stationary_bootstrap(placed, ["hypothesis"], 300, F.lit("s"), F.lit(10.0))
    for table in (boot, block, station):
        one = table.agg(F.count("mean").alias("n"), F.avg("mean").alias("m")).first()
        assert one["n"] == 300 and abs(one["m"] - 0.01) < 0.004


def test_paired_rule_and_missing_sides(spark):
    rows = [(f"s{i}", True, 2.0 + i) for i in range(30)] + [(f"s{i}", False, 1.0 + i) for i in range(25)]
    df = spark.createDataFrame(rows, "session_id string, condition boolean, value double").withColumn("h", F.lit("x"))
    got = E.effect_summary(E.session_means(df, ["h"]), ["h"]).first()
    assert got["paired"] and got["paired_sessions"] == 25 and got["effect"] == 1.0
    few = df.where("value < 12 OR condition")
    got = E.effect_summary(E.session_means(few, ["h"]), ["h"]).first()
    assert not got["paired"] and got["sessions"] == got["conditioned_sessions"] + got["baseline_sessions"]


def test_train_threshold_is_applied_to_test(spark):
    train = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    test = spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double")
    spec = {"type": "quantile_gte", "field": "x", "quantile": 0.75}
    framed = C.with_thresholds(test, train, [spec])
    assert [r["m"] for r in framed.select(C.condition(spec).alias("m")).collect()] == [False, True, False]


def test_opportunity_and_trade_value(spark):
    df = spark.createDataFrame([(0.001, 0.0, 0.002, -0.004, 0.001)], "label_up_5 double, label_down_5 double, label_up_15 double, label_down_15 double, cost double")
    row = W.opportunity_labels(df, 15, 3.0, (5, 15), "cost").first()
    assert row["large"] and row["time_to_excursion"] == 15 and abs(row["surplus"] - 0.001) < 1e-12
    trades = spark.range(200).select(F.lit(0.01).alias("g"), F.lit(0.001).alias("c"), F.lit("k").alias("k"))
    assert W.trade_value(trades, ["k"], "g", "c", "LONG", 100).first()["decision"] == "ENTER_LONG"
    assert W.trade_value(trades.withColumn("g", F.lit(0.0005)), ["k"], "g", "c", "LONG", 100).first()["decision"] == "WAIT"
    assert abs(spark.range(1).select(W.edge_to_cost(F.lit(0.003), F.lit(0.001))).first()[0] - 3) < 1e-12


def test_folds_are_purged(spark):
    days = [dt.datetime(2015, 1, 1) + dt.timedelta(days=i) for i in range(3 * 365)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    folds = W.overlap_violations(W.fold_table(W.tag_folds(df, "ts", 2016, 30, 30), "ts"), 30).orderBy("fold").collect()
    assert [r["fold"] for r in folds] == [2016, 2017] and not any(r["overlaps"] for r in folds) and folds[0]["train_rows"] == 365


def test_abstention_below_threshold(spark):
    df = spark.createDataFrame([([0.3, 0.4, 0.3], 1.0, 0.1, 1.0, 0.1, 2), ([0.34, 0.33, 0.33], 1.0, 0.1, 1.0, 0.1, 0)],
                               "p array<double>, long_gross double, long_cost double, short_gross double, short_cost double, label int")
    d = L.economic_decision(df, 0.5)
    assert d.where("trade").count() == 0 and d.agg(F.sum("net")).first()[0] == 0


def test_scope_closure_detects_cycles(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("d", "c"), ("d", "zz")], "child string, parent string")
    got = {r["id"]: r["status"] for r in A.graph_problems(A.ancestor_closure(nodes, edges, 4), nodes, 4).collect()}
    assert got == {"a": "INVALID_PARENT_GRAPH", "b": "INVALID_PARENT_GRAPH", "c": "OK", "d": "UNKNOWN_CERTIFICATE"}


def test_unsound_ancestries_are_denied(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    edges = spark.createDataFrame(chain + [("orphan", "nobody"), ("self", "self"), ("under", "self"), ("child", "root"), ("grandchild", "child")], "child string, parent string")
    ids = [f"n{i}" for i in range(41)] + ["orphan", "self", "under", "root", "child", "grandchild", "free"]
    day = "2024-01-01 00:00:00"
    rows = [(i, ["PRICE"], ["open"], ["DISCOVERY"], ["desk"], "EVT", "DEV", day, "2025-01-01 00:00:00", day, "2025-01-01 00:00:00", i in ("n40", "root")) for i in ids]
    certs = spark.createDataFrame(rows, "id string, capabilities array<string>, fields array<string>, purposes array<string>, consumers array<string>, instrument string, partition string, "
                                  "period_from string, period_to string, valid_from string, valid_to string, revoked boolean")
    certs = certs.withColumns({c: F.col(c).cast("timestamp") for c in ("period_from", "period_to", "valid_from", "valid_to")})
    closure = A.ancestor_closure(certs, edges)
    now = F.lit("2024-06-01").cast("timestamp")
    wanted = spark.createDataFrame([(i, "PRICE", "DISCOVERY", "desk", "EVT", "DEV", ["open"]) for i in [*ids, "nobody"]],
                                   "certificate string, capability string, purpose string, consumer string, instrument string, partition string, fields array<string>")
    wanted = wanted.withColumns({"period_from": F.lit("2024-02-01").cast("timestamp"), "period_to": F.lit("2024-03-01").cast("timestamp")})
    got = {r["certificate"]: r["reason"] for r in A.authorize(wanted, A.effective_scope(closure, certs), {"PRICE": "DISCOVERY"}, now).collect()}
    state = {r["id"]: r["state"] for r in A.usable_at(closure, certs, now).collect()}
    want = {"orphan": "UNKNOWN_CERTIFICATE", "self": "INVALID_PARENT_GRAPH", "under": "INVALID_PARENT_GRAPH", "n0": "INVALID_PARENT_GRAPH", "n20": "REVOKED_CERTIFICATE", "grandchild": "REVOKED_CERTIFICATE"}
    assert all(got[i] == reason and state[i] == reason for i, reason in want.items())
    assert got["free"] == "FULL_SCOPE_VALIDATED" and state["free"] == "ACTIVE" and got["nobody"] == "UNKNOWN_CERTIFICATE"


def test_canonical_text_is_unambiguous(spark):
    from barwright.functions.hashing import record_hash
    rows = [("a|b", "c"), ("a", "b|c"), ("~", None), (None, "~"), (None, None), ("", "-"), ("-", "")]
    found = spark.createDataFrame(rows, "x string, y string").select(record_hash("V", ["x", "y"]).alias("h")).distinct().count()
    assert found == len(rows)


def test_lexical_relevance_and_edges(spark):
    df = spark.createDataFrame([(1, "El precio sube RÁPIDO", ["oro"], 0.5), (2, "", None, None)], "id long, content string, tags array<string>, confidence double")
    got = {r["id"]: r["relevance"] for r in K.relevance(df, "precio rápido", "content", "tags", "confidence").collect()}
    assert got == {1: round(0.8 * 2 / 5 + 0.1, 6), 2: 0.1}
    bad = spark.createDataFrame([("a", "b", "LIKES", 1)], "source string, target string, relation string, k int")
    with pytest.raises(Exception, match="unknown relation"):
        K.dedupe_edges(bad, ["k"]).collect()


def test_partition_guard(spark):
    df = spark.createDataFrame([("DEV",), ("LOCKED_OOS",)], "partition string")
    assert V.partition_guard(df, "DISCOVERY").count() == 1
    with pytest.raises(PermissionError):
        V.partition_guard(df, "LIVE")


LAGS = [10, 2000, 500, 1500, 100, 10, 1300, 1250, 250, 4000]


def ledger(spark):
    return spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(LAGS)], "symbol string, batch long, lag_seconds double")


def test_recovery_episodes_batch_and_stream_agree(spark, tmp_path):
    rows = S.episode_rows(ledger(spark), ["symbol"], F.floor(F.col("batch") / 3), 1200.0, 300.0)
    got = sorted(tuple(r) for r in S.episodes(rows, ["symbol"]).select("episode", "children", "batches", "closed_batch").collect())
    assert got[:2] == [(1, 2, 4, 4), (6, 2, 3, 8)] and got[2][0] == 9 and got[2][3] is None
    source = tmp_path / "in"
    for i in range(0, len(LAGS), 2):
        ledger(spark).where(F.col("batch").between(i, i + 1)).coalesce(1).write.mode("append").parquet(str(source))
    stream = capture.tick_stream(spark, str(source), ledger(spark).schema, files_per_trigger=1)
    capture.run_to_table(capture.episodes(stream, 1200.0, 300.0), str(tmp_path / "out"), str(tmp_path / "journal"))
    table = capture.episode_table(spark.read.schema(capture.EPISODE_OUTPUT).parquet(str(tmp_path / "out")))
    streamed = sorted(tuple(r) for r in table.select("episode", "children", "batches", "closed_batch").collect())
    assert streamed == got


def test_ingest_is_idempotent_and_resumes(spark, tmp_path):
    ledger(spark).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = capture.tick_stream(spark, str(tmp_path / "in"), ledger(spark).schema)
        capture.ingest(stream, str(tmp_path / "out"), str(tmp_path / "journal"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(LAGS)


def test_lost_clock_and_eligibility(spark):
    base = dt.datetime(2024, 1, 1)
    marks = [(0, True), (4, True), (8, False), (9, True), (20, True), (21, False)]
    samples = spark.createDataFrame([("A", i, base + dt.timedelta(seconds=s), ok) for i, (s, ok) in enumerate(marks)], "symbol string, id long, ts timestamp, valid boolean")
    lost = S.lost_intervals(samples, ["symbol"], ["ts", "id"], F.floor(F.col("id") / 2), 5.0)
    got = sorted(((r["lost_from"] - base).seconds, None if r["lost_to"] is None else (r["lost_to"] - base).seconds) for r in lost.collect())
    assert got == [(4, 9), (9, 20), (20, None)]
    asks = spark.createDataFrame([("A", i, base + dt.timedelta(seconds=a), base + dt.timedelta(seconds=b)) for i, (a, b) in enumerate([(0, 4), (3, 5), (9, 10), (30, 31)])],
                                 "symbol string, id long, window_start timestamp, window_end timestamp")
    assert [r["eligible"] for r in S.temporal_eligibility(asks, lost, ["symbol"]).orderBy("id").collect()] == [True, False, False, False]


def test_contract_fields_alone_open_an_interval(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("A", base + dt.timedelta(hours=i), digits, bid) for i, (digits, bid) in enumerate([(2, 1.0), (2, 1.5), (3, 1.5), (3, 1.7)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, digits int, bid double")
    got = S.contract_intervals(df, ["symbol"], ["ts"], F.hour("ts"), ["digits"]).orderBy("valid_from").collect()
    assert len(got) == 2 and got[0]["valid_to"] == got[1]["valid_from"] and got[1]["valid_to"] is None


def test_ledger_tampering_is_located(spark):
    events = spark.createDataFrame([("L", i, f"c{i}") for i in range(6)], "ledger string, n long, c string")
    chain = S.build_ledger(events, "ledger", ["n"], ["c"])
    assert S.verify_ledger(chain, "ledger").first()["first_violation"] is None
    bad = chain.withColumn("content", F.when(F.col("sequence") == 4, F.lit("x")).otherwise(F.col("content")))
    assert S.verify_ledger(bad, "ledger").first()["first_violation"] == 4
    assert S.verify_ledger(chain.where("sequence <> 3"), "ledger").first()["first_violation"] == 4
