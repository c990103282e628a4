"""Comparison SQL on a feed without gaps: totals of nothing are zero, and a control that cannot be computed does not pass."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("steady"), random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=15 * i, seconds=1), i % 7, "view", round(50 + 30 * rng.random(), 2), f'{{"k": {rng.randrange(1, 40)}}}') for i in range(96 * 20)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name, column, value", [("dx06_integrity_summary", "absent_bars", 0.0), ("t09_negative_controls", "passed", False)])
def test_sql_states_the_rule_of_the_query(spark, feed, name, column, value):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{feed}/events.parquet/*.parquet')")
    got, want = entry.queries()[name](spark, feed).first().asDict(), con.execute(entry.oracle_sql()[name]).fetch_df().iloc[0].to_dict()
    assert got[column] == value and want[column] == value
    assert {k: None if v is None else float(v) for k, v in got.items()} == pytest.approx({k: None if v != v else float(v) for k, v in want.items()})
