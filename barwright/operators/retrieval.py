"""Retrieval over stored records: attribute filters, scaled nearest neighbours, replay and access guard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.hashing import fingerprint, record_hash
from barwright.functions.numeric import count_where, ratio
from barwright.operators.quantiles import attach
from barwright.session import materialize


def attribute_filter(df: DataFrame, equals: Mapping[str, object] | None = None, within: Mapping[str, Sequence] | None = None,
                     between: Mapping[str, tuple] | None = None) -> DataFrame:
    """Composed predicates that Catalyst can push to the scan."""
    for name, value in (equals or {}).items():
        df = df.where(F.col(name) == value)
    for name, values in (within or {}).items():
        df = df.where(F.col(name).isin(*values))
    for name, (low, high) in (between or {}).items():
        df = df.where((F.col(name) >= low) & (F.col(name) < high))
    return df


def _distance(fields: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Mean of |x - q| / range over the fields present on both sides; a zero range counts as one."""
    terms = [F.abs(x - q) / F.when(span > 0, span).otherwise(F.lit(1.0)) for x, q, span in fields]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    return ratio(total, sum((t.isNotNull().cast("int") for t in terms), F.lit(0)))


def nearest(df: DataFrame, query: DataFrame, fields: Sequence[str], k: int, tiebreak: str) -> DataFrame:
    """The k rows nearest to one query row. One aggregate for the ranges, one projection, a bounded top-k."""
    spans = df.agg(*[(F.max(f) - F.min(f)).alias(f"_s_{f}") for f in fields])
    asked = query.select(*[F.col(f).alias(f"_q_{f}") for f in fields]).limit(1)
    scored = attach(attach(df, spans), asked).withColumn("distance", _distance(
        [(F.col(f), F.col(f"_q_{f}"), F.col(f"_s_{f}")) for f in fields]))
    return scored.select(*df.columns, "distance").where(F.col("distance").isNotNull()).orderBy("distance", tiebreak).limit(k)


def nearest_vectors(df: DataFrame, query: DataFrame, vector: str, size: int, k: int, tiebreak: str) -> DataFrame:
    """As `nearest` for array columns: the range of each position comes from one flat aggregate."""
    spans = df.agg(F.array(*[(F.max(F.col(vector)[i]) - F.min(F.col(vector)[i])).cast("double") for i in range(size)]).alias("_span"))
    asked = query.select(F.col(vector).alias("_query")).limit(1)
    both = attach(attach(df, spans), asked)
    parts = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.col("_query").alias("q"), F.col("_span").alias("s")),
                        lambda e: F.abs(e["x"].cast("double") - e["q"].cast("double")) / F.when(e["s"] > 0, e["s"]).otherwise(F.lit(1.0)))
    scored = both.withColumn("distance", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
    return scored.select(*df.columns, "distance").orderBy("distance", tiebreak).limit(k)


def nearest_vectors_of(df: DataFrame, queries: DataFrame, vector: str, key: str, k: int, rows_per_cell: int = 4096, queries_per_cell: int = 256,
                       pivots: int = 16, rings: int = 64) -> DataFrame:
    """(query, key, distance, rank): for each query row the k rows nearest to it, distances as in `nearest_vectors`.

    Exact, with pruning. The distance is a metric, so a row whose distance to a pivot differs from the query's by more than the
    query's k-th distance cannot be among its neighbours. Rows fall into regions, the nearest pivot and a ring around it; pivots and
    rings are constants, so the table of regions has a fixed size. Each query searches its own region first, which bounds its k-th
    distance, then only the regions that the bound leaves. Regions are cut into cells of rows and queries; a cell hands on at most
    k rows per query. `rings` is the most rings of a pivot; fewer are made where regions would hold few rows. Rows and queries without a vector take no part.
    """
    return _search(df, queries, vector, key, k, rows_per_cell, queries_per_cell, pivots, rings)[0]


def compared_share(df: DataFrame, queries: DataFrame, vector: str, key: str, k: int, **sizes: int) -> float:
    """The share of all pairs of query and row that `nearest_vectors_of` compares."""
    return _search(df, queries, vector, key, k, **sizes)[1]


def _search(df: DataFrame, queries: DataFrame, vector: str, key: str, k: int, rows_per_cell: int = 4096, queries_per_cell: int = 256, pivots: int = 16, rings: int = 64) -> tuple[DataFrame, float]:
    kind, given = df.schema[key].dataType.simpleString(), F.col(vector).isNotNull()
    result = f"query {kind}, `{key}` {kind}, distance double"
    # Queries are often some of the rows; own names keep Spark from taking one side's columns for the other's.
    df, queries = df.where(given).select(key, vector), queries.where(given).select(*[F.col(name).alias(name) for name in (key, vector)])
    chosen = df.orderBy(F.xxhash64(key), key).limit(pivots).collect()
    if not chosen:
        return df.sparkSession.createDataFrame([], result + ", rank int"), 0.0
    centres = np.array([row[vector] for row in chosen], dtype=float)
    spans = np.array(df.agg(F.array(*[(F.max(F.col(vector)[i]) - F.min(F.col(vector)[i])).cast("double") for i in range(centres.shape[1])]).alias("_s")).first()[0])
    spans = np.where(spans > 0, spans, 1.0)

    @F.pandas_udf("array<double>")
    def to_pivots(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.empty((0, centres.shape[1]))
        return pd.Series(list(np.stack([(np.abs(x - centre) / spans).mean(axis=1) for centre in centres], axis=1)))

    def placed(table: DataFrame) -> DataFrame:
        near = table.withColumn("_d", to_pivots(vector)).withColumn("_near", F.array_min("_d"))
        return near.withColumn("_home", (F.array_position("_d", F.col("_near")) - 1).cast("int"))

    def ringed(table: DataFrame) -> DataFrame:
        inner = F.coalesce(F.size(F.filter("_edges", lambda edge: edge < F.col("_near"))), F.lit(0))
        return table.join(F.broadcast(edges), "_home", "left").withColumn("_region", F.col("_home") * (rings + 1) + inner).drop("_edges", "_near", "_home")

    rows = materialize(placed(df))
    # A region should hold several times k rows, or searching one bounds nothing.
    rings = max(1, min(rings, rows.count() // (len(centres) * 4 * k)))
    # One row per pivot, and per pivot a fixed number of edges.
    edges = materialize(rows.groupBy("_home").agg(F.percentile_approx("_near", [i / rings for i in range(1, rings)], 10 * rings).alias("_edges")).withColumn("_edges", F.array_distinct("_edges")))
    rows, asked = ringed(rows), materialize(ringed(placed(queries)))
    low, high = ([side(F.col("_d")[i]).alias(f"{name}{i}") for i in range(len(centres))] for side, name in ((F.min, "low"), (F.max, "high")))
    regions = rows.groupBy("_region").agg(F.count(F.lit(1)).alias("_n"), *low, *high).collect()
    numbers = [row["_region"] for row in regions]
    lows, highs = (np.array([[row[f"{side}{i}"] for i in range(len(centres))] for row in regions]) for side in ("low", "high"))
    sizes = {row["_region"]: row["_n"] for row in regions}
    counts = np.array([sizes[number] for number in numbers])
    parts = df.sparkSession.createDataFrame([(number, -(-count // rows_per_cell)) for number, count in sizes.items()], "_region int, _parts int")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            x, ids = np.stack(left[vector].to_numpy()).astype(float), left[key].to_numpy()
            for q, v in zip(right[key].tolist(), right[vector]):
                distance = (np.abs(x - np.asarray(v, dtype=float)) / spans).mean(axis=1)
                best = np.lexsort((ids, distance))[:k]
                found.append(pd.DataFrame({"query": q, key: ids[best], "distance": distance[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query": pd.Series(dtype="int64"), key: pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})

    def searched(wanted: DataFrame) -> tuple[DataFrame, int]:
        """Best rows of the regions that queries name, and how many pairs are compared."""
        wanted = materialize(wanted)
        groups = materialize(wanted.groupBy("_region").agg(F.count(F.lit(1)).alias("_asked")).join(F.broadcast(parts), "_region"))
        pairs = sum(row["_asked"] * sizes[row["_region"]] for row in groups.collect())
        groups = groups.select("_region", "_parts", F.ceil(F.col("_asked") / queries_per_cell).cast("int").alias("_blocks"))

        def dealt(table: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
            return table.select(key, vector, "_region").join(F.broadcast(groups), "_region").select(key, vector, "_region", F.pmod(F.xxhash64(key), F.col(count)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))

        cells = ("_region", "_part", "_block")
        left, right = dealt(rows, "_part", "_parts", "_block", "_blocks"), dealt(wanted, "_block", "_blocks", "_part", "_parts")
        return materialize(left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(cell, result)), pairs

    @F.pandas_udf("array<int>")
    def left_over(distances: pd.Series, farthest: pd.Series, own: pd.Series) -> pd.Series:
        """Regions that may hold a row as near as the farthest of the neighbours found so far.

        Where too few were found, the regions that must be nearest by their far ends give the bound.
        """
        out = []
        for d, most, home in zip(distances, farthest, own):
            ends = (highs + d).min(axis=1)
            order = np.argsort(ends)
            enough = np.searchsorted(np.cumsum(counts[order]), k)
            most = min(most, ends[order[enough]]) if enough < len(order) else most
            least = np.maximum(lows - d, np.asarray(d) - highs).max(axis=1)
            out.append([number for number, bound in zip(numbers, least) if number != home and not bound > most + 1e-9])
        return pd.Series(out)

    ranked = Window.partitionBy("query").orderBy("distance", key)
    first, near_pairs = searched(asked)
    farthest = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query").alias(key), F.col("distance").alias("_most"))
    bounded = asked.join(farthest, key, "left").withColumn("_most", F.coalesce("_most", F.lit(float("inf"))))
    rest, far_pairs = searched(bounded.select(key, vector, F.explode(left_over("_d", "_most", "_region")).alias("_region")))
    every = max(1, sum(sizes.values()) * asked.count())
    return first.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), (near_pairs + far_pairs) / every


def with_record_hash(df: DataFrame, version: str, columns: Sequence[str], name: str = "record_hash") -> DataFrame:
    return df.withColumn(name, record_hash(version, columns))


def replay(df: DataFrame, version: str, columns: Sequence[str], stored: str = "record_hash") -> DataFrame:
    """Recompute every row's hash and compare it with the stored one."""
    return df.withColumn("intact", F.col(stored) == record_hash(version, columns))


def dataset_fingerprints(df: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(dataset).agg(*fingerprint(columns))


def verify_manifest(found: DataFrame, manifest: DataFrame, dataset: str) -> DataFrame:
    """Datasets whose content no longer matches the manifest, or that exist on one side only."""
    want = manifest.select(dataset, *[F.col(c).alias(f"_m_{c}") for c in ("row_count", "hash_sum", "hash_xor")])
    both = found.join(want, dataset, "full")
    same = (F.col("row_count") == F.col("_m_row_count")) & (F.col("hash_sum") == F.col("_m_hash_sum")) & (F.col("hash_xor") == F.col("_m_hash_xor"))
    status = (F.when(F.col("_m_row_count").isNull(), F.lit("UNDECLARED")).when(F.col("row_count").isNull(), F.lit("MISSING"))
               .when(same, F.lit("MATCH")).otherwise(F.lit("MISMATCH")))
    return both.select(dataset, "row_count", status.alias("status"))


# Which partition each research phase may read: fixed values.
PHASE_PARTITIONS = {"DISCOVERY": "DEV", "VALIDATION": "VALIDATION"}


def partition_guard(df: DataFrame, phase: str, column: str = "partition") -> DataFrame:
    """Add the partition predicate ahead of the scan; an unknown phase is refused."""
    if phase not in PHASE_PARTITIONS:
        raise PermissionError(f"phase {phase} may not read any partition")
    return df.where(F.col(column) == PHASE_PARTITIONS[phase])


def access_log(requests: DataFrame, phase: str = "phase", partition: str = "partition") -> DataFrame:
    """Decide every logged request and count the outcomes."""
    allowed = F.lit(False)
    for name, part in PHASE_PARTITIONS.items():
        allowed = allowed | ((F.col(phase) == name) & (F.col(partition) == part))
    decided = requests.withColumn("decision", F.when(allowed, F.lit("ALLOWED")).otherwise(F.lit("DENIED")))
    return decided.groupBy(phase, partition, "decision").agg(F.count(F.lit(1)).alias("requests"))
