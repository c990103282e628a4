"""The driver contract and a sample of queries against their comparison SQL."""

import glob
import numbers
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables not present")
SAMPLE = ("q10_exact_duplicate", "dx01_gap_morphology", "f06_regime", "f19_forward_quote", "h02_fingerprint", "e07_clustered_mean", "m02_holm", "w03_temporal_parts",
          "t05_period_means", "ml11_metrics", "k01_lexical_relevance", "a04_derivation", "st03_duplicate_response", "st11_contract_intervals",
          "a02_authorisation", "x04_partition_guard", "q17_price_jump", "st04_stream_dedupe", "st07_stream_episodes", "st12_stream_heartbeat_sessions")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0 and {"session_id", "effect"} <= set(rows[0].asDict())


def test_every_sql_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 190 and len(queries) - len(sql) < 20


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = entry.queries()[name](spark, DIR).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return sorted(str([None if pd.isna(v) else float(v) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v) for v in r]) for r in frame[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_no_lineage_shortcuts_or_cross_joins():
    root = os.path.join(os.path.dirname(entry.__file__), "barwright")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        text = open(path).read()
        assert "localCheckpoint" not in text and "crossJoin" not in text, path
