"""Comparing the rows of a bucket with each other, however large the bucket.

A bucket of n rows is cut into ceil(n / size) parts; every pair of parts is a cell, and a row goes to the cells of its part. A
task sees whole cells of at most about two parts. It reports per row, never per pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Cells up to this many rows are compared together with others; larger ones alone.
SMALL = 24
PAIRS = 65_536


def deal(rows: DataFrame, bucket: str, row: str, size: int, parts: int) -> DataFrame:
    """Rows of buckets with at least two rows, once per cell: columns bucket, low, high, part, then the others. Sorted by cell."""
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cut = rows.join(counts, bucket).withColumn("_parts", F.ceil(F.col("_n") / size).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64(F.lit("cell"), row), F.col("_parts")).cast("int"))
    others = [name for name in rows.columns if name != bucket]
    whole = cut.where("_parts = 1").select(bucket, F.lit(0).alias("low"), F.lit(0).alias("high"), "part", *others)
    pairs = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda other: F.struct(F.least(other, "part").alias("low"), F.greatest(other, "part").alias("high")))
    split = cut.where("_parts > 1").select(bucket, F.explode(pairs).alias("_c"), "part", *others).select(bucket, "_c.low", "_c.high", "part", *others)
    return whole.union(split).repartition(parts, bucket, "low", "high").sortWithinPartitions(bucket, "low", "high", row)


def whole_cells(batches: Iterable[pa.RecordBatch], limit: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of their cells) with cells complete; the first three columns name the cell."""
    held: list[pa.Table] = []
    count = 0

    def starts(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(3)])
        return np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))])

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
        if count >= limit:
            table = pa.concat_tables(held).combine_chunks()
            at = starts(table)
            if at[-1]:
                yield table.slice(0, at[-1]), at[:-1]
                table = table.slice(at[-1])
            held, count = [table], table.num_rows
            limit = max(limit, count + 1024)
    if count:
        table = pa.concat_tables(held).combine_chunks()
        yield table, starts(table)


def pairs_of(starts: np.ndarray, rows: int, low: np.ndarray, high: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers to compare, some ten thousand at a time: within a part, or across where the cell joins two parts."""
    sizes = np.diff(np.append(starts, rows))
    cell = np.repeat(np.arange(len(starts)), sizes)
    small = sizes <= SMALL
    for step in range(1, int(sizes[small].max(initial=1))):
        a = np.flatnonzero(small[cell[:-step]] & (cell[:-step] == cell[step:])) if step < rows else np.zeros(0, np.int64)
        b = a + step
        use = (low[a] == high[a]) | (part[a] != part[b])
        for at in range(0, len(a), PAIRS):
            yield a[at:at + PAIRS][use[at:at + PAIRS]], b[at:at + PAIRS][use[at:at + PAIRS]]
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        own = np.arange(start, start + size)
        crossed = low[start] != high[start]
        left = own[part[own] == low[start]] if crossed else own
        right = own[part[own] == high[start]] if crossed else own
        for at in range(0, len(left), max(1, PAIRS // max(1, len(right)))):
            some = left[at:at + max(1, PAIRS // max(1, len(right)))]
            a, b = np.repeat(some, len(right)), np.tile(right, len(some))
            use = np.ones(len(a), bool) if crossed else b > a
            yield a[use], b[use]


def roots(rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row number reachable over the links, per row."""
    root = np.arange(rows)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
