"""Every policy has a row, also where no row of the second half is eligible, in the query as in its SQL."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from barwright.operators import conditions as C

NAME = "c08_policy_filters"


def both(spark, folder, first: dt.datetime, bars: list[list[float]]) -> tuple[dict, dict]:
    """Rows by policy of the query and of its SQL on quarter-hour bars with the given values."""
    rows = [(first + dt.timedelta(minutes=15 * i, seconds=k + 1), i % 7, "view", float(value), f'{{"k": {i % 40}}}') for i, values in enumerate(bars) for k, value in enumerate(values)]
    spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    got = {r["policy"]: (r["eligible"], r["entered"]) for r in entry.queries()[NAME](spark, str(folder)).collect()}
    return got, {p: (e, n) for p, e, n in con.execute(f"SELECT policy, eligible, entered FROM ({entry.oracle_sql()[NAME]})").fetchall()}


@pytest.mark.parametrize("first, bars", [(dt.datetime(2024, 1, 14), [[0.01, 100 + i % 5] for i in range(96 * 4)]),
                                         (dt.datetime(2024, 1, 13), [[50 + i % 5] for i in range(96 * 2)])], ids=["never_near_the_low", "only_the_first_half"])
def test_nothing_eligible_counts_zero(spark, tmp_path, first, bars):
    got, want = both(spark, tmp_path, first, bars)
    assert got == want == {p: (0, 0) for p in C.POLICIES}


def test_without_training_rows_learned_policies_wait(spark, tmp_path):
    got, want = both(spark, tmp_path, dt.datetime(2024, 1, 16), [[50 + i % 5] for i in range(96)])
    assert got == want and set(got) == set(C.POLICIES) and {e for e, _ in got.values()} == {86}
    assert [got[p][1] for p in ("LOW_COST", "FAVORABLE_VOLATILITY", "LOW_COST_ATR")] == [0, 0, 0] and got["HIGH_SIGNAL_MAGNITUDE"][1] == 86


def test_limit_of_the_stronger_signal_is_a_product_of_doubles(spark, tmp_path):
    # (0.55 - 0.22) / 0.55 is three fifths and so is 0.8 * 0.75: in doubles both are one step above 0.6.
    got, want = both(spark, tmp_path, dt.datetime(2024, 1, 15), [[0.22 if i % 10 == 0 else 0.55] for i in range(96 * 2)])
    assert got["HIGH_SIGNAL_MAGNITUDE"] == want["HIGH_SIGNAL_MAGNITUDE"] == (96, 96)
