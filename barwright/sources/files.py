"""File sources with contracts: bars in Parquet, headerless text bars, partition admission, tick normalisation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from barwright.operators.sequence import running_count

BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "tick_volume", "spread", "real_volume")
# Provenance keys every bar source must declare: fixed values.
PROVENANCE_KEYS = ("source_id", "broker", "symbol_exact", "symbol_international", "timeframe", "timezone", "point",
                   "digits", "timestamp_semantics")
TIMEFRAME_MINUTES = {"M1": 1, "M5": 5}
SPAN_NAMES = ["file", "row_group", "first_ts", "last_ts", "rows"]
SPAN_TYPES = [pa.string(), pa.int32(), pa.timestamp("us", tz="UTC"), pa.timestamp("us", tz="UTC"), pa.int64()]
TEXT_PATTERN = r"^\d{8} \d{6}$"


def contract_problems(meta: Mapping[str, object], columns: Sequence[str], required: Sequence[str] = BAR_COLUMNS) -> list[str]:
    """Violations of the bar contract, found from the schema and the declared metadata alone."""
    problems = [f"missing column {c}" for c in required if c not in columns]
    problems += [f"missing metadata {k}" for k in PROVENANCE_KEYS if k not in meta]
    if meta.get("timeframe") not in TIMEFRAME_MINUTES:
        problems.append("timeframe must be M1 or M5")
    if not float(meta.get("point", 0) or 0) > 0:
        problems.append("point must be positive")
    if meta.get("timestamp_semantics") != "BAR_OPEN":
        problems.append("timestamps must mark the bar open")
    return problems


def read_bars(spark: SparkSession, path: str, meta: Mapping[str, object]) -> DataFrame:
    """Bars of a declared source; a broken contract is refused before any data is read."""
    df = spark.read.parquet(path)
    problems = contract_problems(meta, df.columns)
    if problems:
        raise ValueError("; ".join(problems))
    return df.select(*BAR_COLUMNS)


def project(df: DataFrame, columns: Sequence[str], limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Column projection with an optional ordered limit; unknown columns are refused."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    out = df.select(*columns)
    if limit is not None:
        out = (out.orderBy(*order) if order else out).limit(limit)
    return out


def decided(spans: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Spans (first_ts, last_ts) with their decision: admitted only if wholly inside the half-open partition.

    The end test is strict after adding the bar length; a span that straddles a border is denied, one wholly outside is ignored, and
    one without times cannot be placed and is denied.
    """
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    last_end = F.col("last_ts") + F.expr(f"interval {minutes} minutes")
    decision = (F.when(F.col("first_ts").isNull() | F.col("last_ts").isNull(), F.lit("DENY_UNKNOWN"))
                 .when((F.col("first_ts") >= low) & (last_end < high), F.lit("ADMIT"))
                 .when((last_end <= low) | (F.col("first_ts") >= high), F.lit("OUTSIDE")).otherwise(F.lit("DENY_STRADDLE")))
    return spans.withColumn("decision", decision)


def admission(df: DataFrame, unit: Column, time: str, start: str, end: str, minutes: int) -> DataFrame:
    """Decisions per storage unit (a file, a block) by one aggregate over the time column, for sources without Parquet footers."""
    spans = df.groupBy(unit.alias("unit")).agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(F.lit(1)).alias("rows"))
    return decided(spans, start, end, minutes)


def _footer(uri: str):
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pq.read_metadata("/" + rest.lstrip("/"))
    system, path = pa.fs.FileSystem.from_uri(uri)
    return pq.read_metadata(path, filesystem=system)


def row_group_spans(spark: SparkSession, path: str, time: str) -> DataFrame:
    """(file, row_group, first_ts, last_ts, rows) of every row group under a folder, from the footers alone.

    Spark lists the files and deals them to tasks; a task opens footers and no data page. A row group without statistics of the time
    column, or with times that name no zone, has null times.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                footer = _footer(uri)
                # Columns of a footer are leaves: nested columns ahead of the time column shift its place.
                leaf = next((i for i in range(footer.num_columns) if footer.schema.column(i).path == time), -1)
                for group in range(footer.num_row_groups):
                    part = footer.row_group(group)
                    found = part.column(leaf).statistics if leaf >= 0 else None
                    low, high = (found.min, found.max) if found is not None and found.has_min_max else (None, None)
                    if getattr(low, "tzinfo", None) is None:
                        low = high = None
                    rows.append((uri, group, low, high, part.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(values, type=kind) for values, kind in zip(list(zip(*rows)) or [()] * 5, SPAN_TYPES)], names=SPAN_NAMES)

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    return listed.mapInArrow(run, "file string, row_group int, first_ts timestamp, last_ts timestamp, rows bigint")


def footer_admission(spans: DataFrame, unit: Column, start: str, end: str, minutes: int) -> DataFrame:
    """Decisions per unit of the `row_group_spans`: one row group that cannot be placed leaves the unit without times."""
    known = F.count_if(F.col("first_ts").isNull() & (F.col("rows") > 0)) == 0
    units = spans.groupBy(unit.alias("unit")).agg(F.when(known, F.min("first_ts")).alias("first_ts"), F.when(known, F.max("last_ts")).alias("last_ts"), F.sum("rows").alias("rows"))
    return decided(units, start, end, minutes)


def store_query(df: DataFrame, columns: Sequence[str], *, action: str | None = None, session: str | None = None,
                regime: str | None = None, ids: Sequence[str] | DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Filtered retrieval; literal predicates reach the scan, a table of ids becomes a semi join."""
    out = df
    for name, value in (("action", action), ("session_id", session), ("state_regime", regime)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if isinstance(ids, DataFrame):
        out = out.join(ids, "experience_id", "left_semi")
    elif ids is not None:
        out = out.where(F.col("experience_id").isin(*ids))
    out = project(out, columns)
    return out.limit(limit) if limit is not None else out


TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                            ("timestamp_raw", "open", "high", "low", "close", "volume_raw")])


def read_text_bars(spark: SparkSession, path: str) -> DataFrame:
    """Headerless semicolon text as strings with the 1-based line of each file.

    Lines are numbered per file split and shifted by the lines of the splits ahead, so a large
    file is never read by one task.
    """
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_seq"))
    numbered = running_count(lines, ["file"], ["_seq"], F.col("block"), "source_line").drop("_seq", "block")
    parts = F.split("value", ";", -1)
    return numbered.select("file", "source_line", F.size(parts).alias("fields"),
                           *[parts[i].alias(f.name) for i, f in enumerate(TEXT_SCHEMA.fields)])


def parse_text_bars(df: DataFrame, offset: str = "GMT-05:00", year: Column | None = None) -> DataFrame:
    """Strict parse of text bars in a fixed-offset clock. A malformed line raises; nothing is skipped."""
    good = F.col("timestamp_raw").rlike(TEXT_PATTERN)
    if year is not None:
        good = good & F.col("timestamp_raw").startswith(year.cast("string"))
    stamp = F.when(good, F.to_timestamp("timestamp_raw", "yyyyMMdd HHmmss")).otherwise(
        F.raise_error(F.concat(F.lit("malformed bar timestamp: "), F.coalesce("timestamp_raw", F.lit("NULL")))).cast("timestamp"))
    rest = [c for c in df.columns if c not in TEXT_SCHEMA.names]
    return df.select(*rest, "timestamp_raw", F.to_utc_timestamp(stamp, offset).alias("ts"),
                     *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume_raw")])


def source_rows(df: DataFrame, name: str = "source_row") -> DataFrame:
    """Rows of a file scan with their position in the whole source: files in order of their paths, rows as stored.

    A row's position in its file comes from the reader; the offsets of the files are sums over one row per file.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def month_ranges(df: DataFrame, time: str) -> DataFrame:
    """Month-long half-open acquisition ranges that cover a table's time span."""
    span = df.agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    months = F.sequence(F.date_trunc("month", "_a"), F.date_trunc("month", "_b"), F.expr("interval 1 month"))
    out = span.select("_a", "_b", F.explode(months).alias("_m"))
    return out.select(F.greatest("_m", "_a").alias("range_start"),
                      F.least(F.col("_m") + F.expr("interval 1 month"), F.col("_b")).alias("range_end")).where("range_start < range_end")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key by a partial aggregate (boundary rows fetched twice keep the last)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def normalize_ticks(df: DataFrame, point: float) -> DataFrame:
    """Wire ticks (milliseconds, bid, ask) to quotes with mid and spread."""
    spread = F.col("ask") - F.col("bid")
    return (df.withColumn("ts", F.timestamp_millis("time_msc"))
              .withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
              .withColumn("spread_price", spread).withColumn("spread_points", spread / F.lit(point)))
