"""One injected anomaly gives one code; features never see the future; files and sinks keep their contracts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.operators import actions as A, diagnostics as D, features as X, quality as Q
from barwright.plans.registry import as_output
from barwright.sources import files, sinks

META = {"symbol": "GOLD", "point": 0.01}
START = dt.datetime(2016, 1, 4, 12, 0)


def bars(n=200):
    rows = []
    for i in range(n):
        p = 2000 + 0.01 * i
        rows.append(["D", i, "GOLD", START + dt.timedelta(minutes=i), p, p + 0.1, p - 0.1, p, 100.0, 20.0, 0.0])
    return rows


SCHEMA = "dataset string, source_row long, symbol string, ts timestamp, open double, high double, low double, close double, tick_volume double, spread double, real_volume double"
COLUMN = {"high": 5, "close": 7, "tick_volume": 8, "spread": 9, "symbol": 2}


def counts(spark, rows):
    certified = Q.certify(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), META, 1)
    found = {r["name"]: r["findings"] for r in Q.finding_counts(Q.findings_of(certified)).where("kind = 'code'").collect()}
    return found, Q.verdict(certified).first()


@pytest.mark.parametrize("column,value,code", [
    ("high", 1.0, "INVALID_OHLC"), ("close", -1.0, "NONPOSITIVE_PRICE"), ("spread", -1.0, "NEGATIVE_SPREAD"), ("close", float("inf"), "NONFINITE_OR_NULL"),
    ("tick_volume", -1.0, "NEGATIVE_VOLUME"), ("symbol", "OTHER", "SYMBOL_CHANGE")])
def test_row_anomalies(spark, column, value, code):
    rows = bars()
    rows[7][COLUMN[column]] = value
    found = {r["code"] for r in Q.row_findings(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), META, 1, ["dataset"]).collect()}
    assert code in found


def test_duplicates_conflicts_and_gap(spark):
    rows = bars()
    rows.append([*rows[0][:1], 200, *rows[0][2:]])
    conflict = list(rows[5])
    conflict[1], conflict[9] = 201, 25.0
    rows.append(conflict)
    del rows[50]
    found, verdict = counts(spark, rows)
    assert found["EXACT_DUPLICATE"] == 1 and found["CONFLICTING_TIMESTAMP"] == 2 and found["GAP"] == 1
    assert verdict["status"] == "REJECTED" and verdict["clean_rows"] == 200


def test_gap_alone_is_exploratory(spark):
    rows = bars()
    del rows[50]
    found, verdict = counts(spark, rows)
    assert found == {"GAP": 1} and verdict["status"] == "EXPLORATORY_ONLY"


def test_jump_and_stale(spark):
    rows = bars()
    for i in range(80, 91):
        rows[i][4:8] = [2200.0, 2200.1, 2199.9, 2200.0]
    found, _ = counts(spark, rows)
    assert found["PRICE_JUMP"] == 2 and found["STALE_RUN"] == 6


def test_a_third_of_rows_as_copies_of_one_bar(spark):
    rows = bars(60) + [[*bars(1)[0][:1], 1000 + i, *bars(1)[0][2:]] for i in range(40)]
    found, verdict = counts(spark, rows)
    assert found["EXACT_DUPLICATE"] == 40 and verdict["clean_rows"] == 60


SPEC = X.FeatureSpec(chunk_bars=70)


def frame(spark, rows, spec=SPEC):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).withColumn("bar_index", (F.unix_micros("ts") / 60_000_000).cast("bigint"))
    return X.build_frame(df, spec)


def test_future_never_reaches_the_past(spark):
    base, changed = bars(), bars()
    for r in changed[180:]:
        r[4:8] = [x * 2 for x in r[4:8]]
    states = ["source_row", *[c for c in frame(spark, base).columns if c.startswith("state_") and c != "state_max_source_ts"]]
    a = frame(spark, base).where("source_row <= 100").select(states).orderBy("source_row").collect()
    b = frame(spark, changed).where("source_row <= 100").select(states).orderBy("source_row").collect()
    assert a == b


def test_gap_voids_warmup_and_labels_keep_exact_horizons(spark):
    rows = bars()
    del rows[70]
    f = {r["source_row"]: r for r in frame(spark, rows).collect()}
    assert f[80]["state_atr"] is None and f[66]["label_return_5"] is None and f[65]["label_return_5"] is None and f[64]["label_return_5"] is not None
    for r in frame(spark, bars()).where("label_return_15 IS NOT NULL").collect():
        assert (r["label_source_ts_15"] - r["ts"]) == dt.timedelta(minutes=15) and r["state_max_source_ts"] < r["decision_ts"]


def test_chunked_frame_equals_one_big_chunk(spark):
    small = as_output(frame(spark, bars())).orderBy("source_row").collect()
    whole = as_output(frame(spark, bars(), X.FeatureSpec(chunk_bars=1 << 40))).orderBy("source_row").collect()
    assert small == whole


def test_actions_are_consistent(spark):
    ticks = spark.createDataFrame([("GOLD", START, 1.0, 2.0, 0)], "symbol string, ts timestamp, bid double, ask double, tick_id long")
    e = A.expand_actions(A.attach_quotes(frame(spark, bars()).where("label_return_5 IS NOT NULL"), ticks, SPEC), SPEC)
    row = e.groupBy("action").agg(F.avg("gross_5").alias("g"), F.avg("net_5").alias("n"), F.avg(F.abs(F.col("gross_5") - F.col("net_5") - F.col("cost_5"))).alias("d")).collect()
    by = {r["action"]: r for r in row}
    assert by["WAIT"]["g"] == 0 and by["LONG"]["g"] == -by["SHORT"]["g"] and all(r["d"] == 0 for r in row)
    assert by["LONG"]["n"] < by["LONG"]["g"] and set(r[0] for r in e.select("slippage_status").distinct().collect()) == {A.SLIPPAGE_STATUS}


def test_weekend_morphology(spark):
    times = [dt.datetime(2016, 1, 8, 21, 59), dt.datetime(2016, 1, 10, 23, 0), dt.datetime(2016, 1, 11, 0, 0)] + [dt.datetime(2016, 1, 11, 0, 2 + i) for i in range(8)]
    rows = [("D", i, "GOLD", t, 100.0, 101.0, 99.0, 100.0, 20.0, 0.0, 0.0) for i, t in enumerate(times)]
    facts = Q.add_neighbour_facts(spark.createDataFrame(rows, SCHEMA), ["dataset"], 1)
    kinds = {r["morphology"]: r["gaps"] for r in D.gap_summary(D.gap_table(facts, 1)).collect()}
    assert kinds == {"WEEKEND_SPANNING": 2, "INTRADAY": 1}
    chunk = F.floor(F.unix_micros("ts") / F.lit(86_400_000_000))
    episode = D.stale_episodes(facts, ["dataset"], chunk, 1).collect()
    assert len(episode) == 1 and episode[0]["gap_edges"] == 3 and episode[0]["bars"] == 11
    blocks = D.segments(facts, facts.where("is_stale"), ["dataset"], chunk, 1).collect()
    assert sum(r["rows"] for r in blocks) == 11


def test_text_source(spark, tmp_path):
    lines = [f"2016{m:02d}04 1200{s:02d};1;2;0.5;1.5;10" for m in (1, 7) for s in range(40)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        raw = files.read_text_bars(spark, str(tmp_path / "a.csv"))
        rows = files.parse_text_bars(raw).orderBy("source_line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["source_line"] for r in rows] == list(range(1, 81)) and {r["ts"].hour for r in rows} == {17}
    (tmp_path / "b.csv").write_text("2016-01-04;1;2;0.5;1.5;10\n")
    with pytest.raises(Exception, match="malformed"):
        files.parse_text_bars(files.read_text_bars(spark, str(tmp_path / "b.csv"))).collect()


def test_contracts_and_publish(spark, tmp_path):
    df = spark.createDataFrame([tuple(r) for r in bars(20)], SCHEMA)
    with pytest.raises(ValueError):
        files.project(df, ["close", "nothing"])
    path = str(tmp_path / "out")
    assert sinks.publish(df, path) == "PUBLISHED" and sinks.publish(df.orderBy(F.desc("ts")), path) == "UNCHANGED"
    with pytest.raises(sinks.PublishConflict):
        sinks.publish(df.limit(19), path)
    with pytest.raises(ValueError, match="missing metadata"):
        files.read_bars(spark, path, {"timeframe": "M1"})


def test_admission_denies_straddling_files(spark):
    df = spark.createDataFrame([("in", dt.datetime(2016, 1, 1)), ("edge", dt.datetime(2019, 12, 31, 23, 59)), ("edge", dt.datetime(2020, 1, 1)), ("out", dt.datetime(2021, 1, 1))], "f string, ts timestamp")
    got = {r["unit"]: r["decision"] for r in files.admission(df, F.col("f"), "ts", "2015-01-01", "2020-01-01", 1).collect()}
    assert got == {"in": "ADMIT", "edge": "DENY_STRADDLE", "out": "OUTSIDE"}
