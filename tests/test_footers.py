"""Admission by footers: row groups inside one file, missing statistics, times without a zone; landing of stream slices."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from barwright.sources import files
from barwright.streaming import capture

START = dt.datetime(2019, 12, 31, 22, tzinfo=dt.timezone.utc)


def written(path, zone="UTC", **options):
    times = [START + dt.timedelta(minutes=30 * i) for i in range(8)]
    table = pa.table({"extra": [{"a": i, "b": i} for i in range(8)], "ts": pa.array(times, type=pa.timestamp("us", tz=zone)), "close": [float(i) for i in range(8)]})
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path, row_group_size=2, **options)


def decisions(df, key):
    return {r[key]: r["decision"] for r in df.collect()}


def test_row_groups_inside_one_file(spark, tmp_path):
    written(tmp_path / "a b%20c" / "one.parquet")
    spans = files.row_group_spans(spark, str(tmp_path), "ts")
    assert [(r["row_group"], r["rows"]) for r in spans.orderBy("row_group").collect()] == [(0, 2), (1, 2), (2, 2), (3, 2)]
    groups = decisions(files.decided(spans, "2015-01-01", "2020-01-01", 1), "row_group")
    assert groups == {0: "ADMIT", 1: "ADMIT", 2: "OUTSIDE", 3: "OUTSIDE"}
    assert decisions(files.decided(spans, "2015-01-01", "2019-12-31 23:15", 1), "row_group")[1] == "DENY_STRADDLE"
    whole = files.footer_admission(spans, F.lit("all"), "2015-01-01", "2020-01-01", 1)
    assert decisions(whole, "unit") == {"all": "DENY_STRADDLE"}
    # The last bar ends at 01:31; the end test is strict.
    assert decisions(files.footer_admission(spans, F.lit("all"), "2019-12-31 22:00", "2020-01-01 01:31", 1), "unit") == {"all": "DENY_STRADDLE"}
    assert decisions(files.footer_admission(spans, F.lit("all"), "2019-12-31 22:00", "2020-01-01 01:32", 1), "unit") == {"all": "ADMIT"}


def test_files_that_cannot_be_placed(spark, tmp_path):
    written(tmp_path / "bare" / "x.parquet", write_statistics=False)
    written(tmp_path / "naive" / "x.parquet", zone=None)
    written(tmp_path / "good" / "x.parquet")
    spans = files.row_group_spans(spark, str(tmp_path), "ts")
    got = decisions(files.footer_admission(spans, F.regexp_extract("file", "([a-z]+)/x", 1), "2015-01-01", "2021-01-01", 1), "unit")
    assert got == {"bare": "DENY_UNKNOWN", "naive": "DENY_UNKNOWN", "good": "ADMIT"}
    assert {r["first_ts"] for r in files.row_group_spans(spark, str(tmp_path), "absent").collect()} == {None}


def test_a_slice_of_many_files_is_one_micro_batch(spark, tmp_path):
    landing, out, journal = (str(tmp_path / name) for name in ("landing", "out", "journal"))
    for part in range(2):
        capture.land(spark.range(part * 40, part * 40 + 40), landing, "id", records=5)
        capture.ingest(capture.tick_stream(spark, landing, spark.range(1).schema, None), out, journal)
    assert spark.read.parquet(landing).select("_metadata.file_path").distinct().count() >= 16
    got = spark.read.parquet(out).groupBy("micro_batch").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("id").alias("n"))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 39, 40), (1, 40, 79, 40)]
