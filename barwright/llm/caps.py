"""Near-duplicate vectors by spherical-cap filters.

Method: the coordinates are cut into BLOCKS parts, each with a random code of unit vectors; every combination of one code word per
part is a filter direction (a structured random product code). A vector belongs to all directions whose inner product with it
exceeds a bound. List decoding finds them without visiting the others: partial sums of code words are followed only while the best
completion still reaches the bound. Vectors meet in their filters and are verified by cosine; inside the components so found
every pair is compared, so link counts don't depend on which filters two vectors share.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm.cells import deal, roots, whole_cells
from barwright.llm.common import batch_of
from barwright.llm.components import connected_components
from barwright.session import materialize

THRESHOLD, BLOCKS = 0.9, 3
# Codes, each in a rotation of its own: what one code sees badly another sees well. Vectors of one filter on average; fewest code
# words of a part; filters of a code that a pair at the threshold should share; filters that a vector has in each code at least.
CODES, OCCUPANCY, FEWEST, SHARED, LEAST = 4, 96, 8, 1.2, 3
PART, BATCH = 1024, 2048


@dataclass
class Code:
    rotation: np.ndarray         # dimension x dimension
    words: list[np.ndarray]      # per part: coordinates x words
    cuts: list[int]
    bound: float


@lru_cache(maxsize=32)
def code_for(dimension: int, vectors: int, which: int = 0, threshold: float = THRESHOLD) -> Code:
    """Code words and bound for so many vectors: the more there are, the rarer a filter, and the more filters a vector gets."""
    share = min(0.01, OCCUPANCY / max(vectors, 1))
    # Inner products with a random direction are near normal, so this is the chance to share a filter that one of two exceeds.
    depth = NormalDist().inv_cdf(1 - share)
    filters = SHARED / (1 - NormalDist().cdf((1 - threshold) * depth / math.sqrt(1 - threshold ** 2)))
    size = max(FEWEST, math.ceil((filters / share) ** (1 / BLOCKS)))
    rng = np.random.default_rng((dimension, which))
    rotation = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
    cuts = [round(i * dimension / BLOCKS) for i in range(BLOCKS + 1)]
    words = [rng.normal(size=(b - a, size)) for a, b in zip(cuts, cuts[1:])]
    words = [w / np.maximum(np.linalg.norm(w, axis=0), 1e-300) for w in words]
    # The bound is where random vectors exceed the wanted number of this code's directions.
    probe = rng.normal(size=(256, dimension))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    sums = sum(probe[:, a:b] @ w[:, rng.integers(0, size, 8192)] for a, b, w in zip(cuts, cuts[1:], words))
    return Code(rotation, words, cuts, float(np.quantile(sums, 1 - min(0.5, filters / size ** BLOCKS))))


def exceeding(parts: list[np.ndarray], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every direction whose sum over the parts reaches the bound."""
    most = [part.max(axis=1) for part in parts]
    row, number, value = np.arange(len(parts[0])), np.zeros(len(parts[0]), np.int64), np.zeros(len(parts[0]))
    for i, part in enumerate(parts):
        rest = sum(most[i + 1:], np.zeros(len(part)))
        reached = value[:, None] + part[row]
        at, word = np.nonzero(reached + rest[row][:, None] >= bound)
        row, number, value = row[at], number[at] * part.shape[1] + word, reached[at, word]
    return row, number


def decode(unit: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every direction above the bound; a vector with fewer than LEAST gets a lower bound of its own."""
    turned = unit @ code.rotation
    parts = [turned[:, a:b] @ w for a, b, w in zip(code.cuts, code.cuts[1:], code.words)]
    left, bound, rows, numbers = np.arange(len(unit)), code.bound, [], []
    while len(left):
        row, number = exceeding([part[left] for part in parts], bound)
        enough = np.bincount(row, minlength=len(left)) >= LEAST
        rows.append(left[row[enough[row]]])
        numbers.append(number[enough[row]])
        left, bound = left[~enough], bound - 0.05 * abs(code.bound) - 1e-3
    return np.concatenate(rows), np.concatenate(numbers)


def units(raw: list[bytes], kind: str) -> np.ndarray:
    vectors = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def described(df: DataFrame, vector: str, key: str, kind: str) -> DataFrame:
    """(key, set_key, dimension, vector) per row; the last three are null where a vector can have no links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, raws = [], [], []
            for value in batch.column(1).to_pylist():
                usable = value is not None and len(value) > 0 and None not in value
                numbers = np.array(value, dtype=np.float64) + 0.0 if usable else np.zeros(0)
                usable = usable and np.isfinite(numbers).all() and numbers.any()
                raw = numbers.astype(kind).tobytes() if usable else None
                keys.append(hashlib.blake2b(raw, digest_size=16).hexdigest() if usable else None)
                sizes.append(len(numbers) if usable else None)
                raws.append(raw)
            yield batch_of((key, "set_key", "dimension", "vector"), (batch.column(0), pa.array(keys, type=pa.string()), pa.array(sizes, type=pa.int32()), pa.array(raws, type=pa.binary())))

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(vector))
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return rows.mapInArrow(run, f"`{key}` bigint, set_key string, dimension int, vector binary")


def filtered(classes: DataFrame, total: int, kind: str) -> DataFrame:
    """(bucket, number, vector): each vector once per filter it exceeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sizes, raws = (batch.column(i).to_pylist() for i in range(3))
            for size in sorted(set(sizes)):
                own = [i for i, other in enumerate(sizes) if other == size]
                for start, which in itertools.product(range(0, len(own), 256), range(CODES)):
                    some = own[start:start + 256]
                    row, number = decode(units([raws[i] for i in some], kind), code_for(size, total, which))
                    yield batch_of(("bucket", "number", "vector"), (pa.array(((number * CODES + which) << 16) + size), pa.array([numbers[some[r]] for r in row.tolist()], type=pa.int64()),
                                                                    pa.array([raws[some[r]] for r in row.tolist()], type=pa.binary())))

    return classes.select("number", "dimension", "vector").mapInArrow(run, "bucket bigint, number bigint, vector binary")


def linked(dealt: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(number, links, root) per row of each cell that has a link there: vectors linked to it, and the least one reached."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_cells(batches, 4096):
            low, high, part, number, copies = (table.column(i).to_numpy() for i in range(1, 6))
            raws = table.column("vector").to_pylist()
            links, left, right = np.zeros(table.num_rows, np.int64), [], []
            for start, end in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist()):
                unit = units(raws[start:end], kind)
                close = unit @ unit.T >= threshold
                np.fill_diagonal(close, False)
                if low[start] != high[start]:
                    close &= part[start:end, None] != part[None, start:end]
                links[start:end] = close @ copies[start:end]
                # One link per row joins it to the least row it reaches; the reverse links make the rest.
                linked_rows = np.flatnonzero(close.any(axis=1))
                left.append(start + linked_rows)
                right.append(start + close[linked_rows].argmax(axis=1))
            root = roots(table.num_rows, np.concatenate(left), np.concatenate(right))
            own = np.flatnonzero(links)
            yield batch_of(("number", "links", "root"), (pa.array(number[own]), pa.array(links[own]), pa.array(number[root[own]])))

    return dealt.mapInArrow(run, "number bigint, links bigint, root bigint")


def near_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    n_links: other rows with cosine of at least the threshold, equal vectors included; component_id: least key reachable over links,
    itself included; kept: key equals component_id. Null, empty and zero vectors and those with null or non-finite components link
    with nothing; vectors of different dimensions neither. Repeated keys are rows of their own, null keys are never a component's id
    unless it has no other. Empty table: no rows. Extra columns are not read.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    rows = materialize(described(df, vector, key, kind))
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key", "dimension").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("number"), "set_key", "dimension", "least", "copies", "vector"))
    spread = filtered(classes.repartition(parts, "number"), classes.count(), kind).select("bucket", "number", F.lit(1).cast("bigint").alias("copies"), "vector")
    edges = linked(deal(spread, "bucket", "number", PART, parts), kind, threshold).select(F.col("number").alias("a"), F.col("root").alias("b"))
    groups = materialize(connected_components(edges))
    members = groups.join(classes, F.col("node") == F.col("number")).select(F.col("root").alias("bucket"), "number", "copies", "vector")
    links = linked(deal(members, "bucket", "number", PART, parts), kind, threshold).groupBy("number").agg(F.sum("links").alias("links"))
    solved = classes.select("number", "set_key", "least", "copies").join(groups, F.col("number") == F.col("node"), "left").join(links, "number", "left").select(
        "set_key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "number").alias("group"))
    solved = materialize(solved)
    solved = solved.join(solved.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("set_key", "n_links", "component_id")
    named = rows.select(key, "set_key").join(solved, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return named.select(F.col(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))
