"""N-gram Jaccard join with Bayesian candidate pruning.

Method: documents are sets of five-word shingles. Equal sets are one class. Classes that agree in a band of MinHash values meet in
a bucket, where the values of a pair are compared a block at a time; with m of n values equal and a uniform prior, the
posterior probability that the similarity reaches the threshold is the chance of at most m hits in n + 1 draws of that
threshold, and a pair below the tolerance is dropped. What survives is joined into candidate groups; within a group
every pair is pruned the same way and then compared exactly, set against set. Counts and group roots leave a task, pairs never do.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm.cells import deal, pairs_of, roots, whole_cells
from barwright.llm.common import batch_of, map_arrow
from barwright.llm.components import connected_components
from barwright.session import materialize

WORDS, THRESHOLD = 5, 0.8
# MinHash values; a pair at the threshold shares none of the bands with a chance of 3 in a million.
BANDS, DEPTH, BLOCK = 32, 5, 32
VALUES = BANDS * DEPTH
TOLERANCE = 1e-6
# Rows of one part of a bucket, of one part of a candidate group; bytes of text hashed together; columns of one product.
BUCKET_PART, GROUP_PART, SLICE, COLUMNS = 1024, 256, 1 << 20, 4096
# Marks (8 bytes each) of documents to verify that are sent to all tasks at most.
FILTERED = 500_000
_rng = np.random.default_rng(20240607)
_SCALE = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_BASE, _STEP = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
# Digits, letters and every byte above ASCII belong to words.
_IN_WORD = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * _STEP
    return value ^ (value >> np.uint64(29))


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, letters lowered. Fewer words than a shingle make one shingle; no word, none."""
    raw = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return [np.zeros(0, np.uint64)] * len(texts)
    length = end - begin
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _BASE))
    word = mixed(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * power[place], first) + length.astype(np.uint64))
    offset = np.cumsum([0] + [len(one) + 1 for one in raw])
    bound = np.searchsorted(begin, offset)
    joint = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        joint = joint * _STEP + word[j:len(word) - words + 1 + j]
    joint = mixed(joint)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(joint[a:b - words + 1]))
        else:
            short = np.uint64(b - a)
            for value in word[a:b]:
                short = short * _STEP + value
            out.append(mixed(np.array([short]))if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows x VALUES, 32 bit) of non-empty sets."""
    out = np.empty((len(sets), VALUES), np.uint32)
    starts = np.cumsum([0] + [len(one) for one in sets[:-1]])
    every = np.concatenate(sets)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(((every * _SCALE[k] + _SHIFT[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least number of equal ones that keeps a pair) after each block."""
    out = []
    for n in range(BLOCK, VALUES + 1, BLOCK):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(values: np.ndarray, a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no block of values rules out."""
    equal = np.zeros(len(a), np.int64)
    for n, m in rule:
        if not len(a):
            break
        equal += (values[a, n - BLOCK:n] == values[b, n - BLOCK:n]).sum(axis=1)
        keep = equal >= m
        a, b, equal = a[keep], b[keep], equal[keep]
    return a, b


def text_slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE:
            yield start, texts[start:i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def set_key(one: np.ndarray) -> str:
    return hashlib.blake2b(one.tobytes(), digest_size=16).hexdigest()


def described(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, mark, set_key, n, values, bands) per row; a text without words has null for the last four."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) * _STEP
        for batch in batches:
            texts = [value or "" for value in batch.column(2).to_pylist()]
            keys, counts, values, bands = [], [], [], []
            with np.errstate(over="ignore"):
                for _, some in text_slices(texts):
                    sets = shingles(some)
                    full = [one for one in sets if len(one)]
                    made = iter(signatures(full) if full else ())
                    for one in sets:
                        if not len(one):
                            for column in (keys, counts, values, bands):
                                column.append(None)
                            continue
                        own = next(made)
                        band = salt.copy()
                        for part in own.reshape(BANDS, DEPTH).T:
                            band = mixed(band * _STEP + part)
                        keys.append(set_key(one))
                        counts.append(len(one))
                        values.append(own.astype("<u2").tobytes())
                        bands.append(band.view(np.int64))
            yield batch_of((key, "mark", "set_key", "n", "values", "bands"), (batch.column(0), batch.column(1), pa.array(keys, type=pa.string()), pa.array(counts, type=pa.int32()), pa.array(values, type=pa.binary()), pa.array(bands, type=pa.list_(pa.int64()))))

    rows = df.select(F.col(key).cast("bigint").alias(key), F.xxhash64(F.lit(1), F.col(text)).alias("mark"), F.col(text))
    return map_arrow(rows, run, f"`{key}` bigint, mark bigint, set_key string, n int, values binary, bands array<bigint>")


def candidate_edges(dealt: DataFrame) -> DataFrame:
    """(a, b) from each bucket cell: every class and the least class it reaches over surviving pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = least_matches()
        for table, starts in whole_cells(batches):
            low, high, part, number = (table.column(i).to_numpy() for i in range(1, 5))
            values = np.frombuffer(b"".join(table.column("values").to_pylist()), dtype="<u2").reshape(-1, VALUES)
            links = [surviving(values, a, b, rule) for a, b in pairs_of(starts, table.num_rows, low, high, part)]
            a, b = (np.concatenate(side) if links else np.zeros(0, np.int64) for side in (zip(*links) if links else ((), ())))
            root = roots(table.num_rows, a, b)
            own = np.flatnonzero(root != np.arange(len(root)))
            yield batch_of(("a", "b"), (pa.array(number[own]), pa.array(number[root[own]])))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: one matrix product per cell where pairs are many."""
    if len(a) < 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], dtype=np.int64)
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    sizes = [len(sets[i]) for i in used.tolist()]
    _, token, copies = np.unique(np.concatenate([sets[i] for i in used.tolist()]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), sizes)
    # A shingle of one document alone is in no intersection.
    shared = copies > 1
    column = (np.cumsum(shared) - 1)[token]
    row, column = row[shared[token]], column[shared[token]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, out = int(shared.sum()), np.zeros(len(a), np.float64)
    for start in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        block = np.zeros((len(used), min(COLUMNS, total - start)), np.float32)
        block[row[lo:hi], column[lo:hi] - start] = 1
        out += (block @ block.T)[left, right]
    return np.rint(out).astype(np.int64)


def verified(dealt: DataFrame) -> DataFrame:
    """(number, links, root) from each cell of a candidate group: documents exactly linked to a class, and the least class reached."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = least_matches()
        for table, starts in whole_cells(batches, 1024):
            low, high, part, number, copies = (table.column(i).to_numpy() for i in range(1, 6))
            sets = [np.frombuffer(one, dtype="<u8") for one in table.column("set").to_pylist()]
            size = np.array([len(one) for one in sets], dtype=np.int64)
            values = np.frombuffer(b"".join(table.column("values").to_pylist()), dtype="<u2").reshape(-1, VALUES)
            links, kept = np.zeros(table.num_rows, np.int64), []
            for a, b in pairs_of(starts, table.num_rows, low, high, part):
                fits = (np.minimum(size[a], size[b]) >= THRESHOLD * np.maximum(size[a], size[b]) - 1e-9) & (number[a] != number[b])
                a, b = surviving(values, a[fits], b[fits], rule)
                common = common_counts(sets, a, b)
                alike = common >= THRESHOLD * (size[a] + size[b] - common) - 1e-9
                a, b = a[alike], b[alike]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                kept.append((a, b))
            a, b = (np.concatenate(side) if kept else np.zeros(0, np.int64) for side in (zip(*kept) if kept else ((), ())))
            root = roots(table.num_rows, a, b)
            own = np.flatnonzero(links)
            yield batch_of(("number", "links", "root"), (pa.array(number[own]), pa.array(links[own]), pa.array(number[root[own]])))

    return dealt.mapInArrow(run, "number bigint, links bigint, root bigint")


def with_sets(df: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """The shingle sets of the wanted classes (number, bucket, copies, values, first, mark), from the row that stands for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value or "" for value in batch.column(0).to_pylist()]
            with np.errstate(over="ignore"):
                sets = [one.astype("<u8").tobytes() for _, some in text_slices(texts) for one in shingles(some)]
            yield batch_of(("bucket", "number", "copies", "values", "set"), (*batch.columns[1:], pa.array(sets, type=pa.binary())))

    rows = df.select(F.col(key).cast("bigint").alias("_key"), F.xxhash64(F.lit(1), F.col(text)).alias("_mark"), F.col(text).alias("_text"))
    marks = wanted.select("mark")
    if marks.limit(FILTERED + 1).count() <= FILTERED:
        # So few marks fit every task: other texts stay where they are. With more of them all texts are dealt by mark.
        rows = rows.join(F.broadcast(marks), F.col("_mark") == F.col("mark"), "left_semi")
    found = rows.join(wanted, (F.col("_mark") == F.col("mark")) & F.col("_key").eqNullSafe(F.col("first")))
    # Repeated rows of the document that stands for a class would give it twice.
    found = found.select("_text", "bucket", "number", "copies", "values").dropDuplicates(["number"])
    return map_arrow(found, run, "bucket bigint, number bigint, copies bigint, values binary, set binary")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, mark, class_id, n_links, component_id, kept.

    class_id: least key among rows with the same shingle set; n_links: other rows whose Jaccard similarity is at least the threshold,
    copies included; component_id: least key reachable over links; kept: this row stands for its component (of equal keys the
    one with the least mark, a hash of the text; of repeated rows each). Rows without a word (null, empty, signs only) link with
    nothing and are their own class. Null keys are least only where a component has no other. Extra columns are not read.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(described(df, text, key))
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min(F.when(F.col(key).isNotNull(), F.struct(key, "mark"))).alias("low"), F.min("mark").alias("any_mark"), F.count(F.lit(1)).alias("copies"), F.first("values").alias("values"), F.first("bands").alias("bands"))
    # Numbers are fixed once the table is written.
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("number"), "set_key", F.col(f"low.{key}").alias("first"), F.coalesce("low.mark", "any_mark").alias("mark"), "copies", "values", "bands"))
    banded = classes.select("number", F.explode("bands").alias("bucket"))
    # Only classes that meet another carry their values on.
    met = banded.join(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "bucket")
    met = met.join(classes.select("number", "values"), "number").select("bucket", "number", "values")
    groups = materialize(connected_components(candidate_edges(deal(met, "bucket", "number", BUCKET_PART, parts))))
    wanted = materialize(groups.join(classes, F.col("node") == F.col("number")).select(F.col("root").alias("bucket"), "number", "copies", "values", "first", "mark"))
    links = materialize(verified(deal(with_sets(df, wanted, text, key), "bucket", "number", GROUP_PART, parts)))
    roots_of = connected_components(links.select(F.col("number").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("number").agg(F.sum("links").alias("links"))
    solved = classes.select("number", "set_key", "first", "mark", "copies").join(roots_of, F.col("number") == F.col("node"), "left").join(counts, "number", "left").select(
        "set_key", F.col("first").alias("class_id"), F.col("mark").alias("class_mark"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "number").alias("group"))
    solved = materialize(solved)
    stands = solved.groupBy("group").agg(F.min(F.when(F.col("class_id").isNotNull(), F.struct("class_id", "class_mark"))).alias("low"), F.min("class_mark").alias("any_mark"))
    solved = solved.join(stands, "group").select("set_key", "class_id", "n_links", F.col("low.class_id").alias("component_id"), F.coalesce("low.class_mark", "any_mark").alias("component_mark"))
    named = rows.select(key, "mark", "set_key").join(solved, "set_key", "left")
    alone = F.col("set_key").isNull()
    return named.select(F.col(key), "mark", F.when(alone, F.col(key)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                        F.when(alone, F.col(key)).otherwise(F.col("component_id")).alias("component_id"),
                        (alone | (F.col(key).eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("component_mark")))).alias("kept"))


def distinct_documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df, all columns whatever their names, with one document of each group of near-duplicates.

    Documents without words stay; of repeated rows (equal key and text) one stays. Texts move at most once: rows that go are taken
    away by an anti join on narrow keys, and only rows that are repeated are brought together.
    """
    found = materialize(near_duplicates(df, text, key).select(F.col(key).alias("key"), "mark", "kept"))
    gone = found.where("NOT kept").select("key", "mark").distinct()
    repeated = found.where("kept").groupBy("key", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "mark")
    rows = df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"), F.col(key).cast("bigint").alias("own_key"), F.xxhash64(F.lit(1), F.col(text)).alias("own_mark"))

    def meet(marks: DataFrame, how: str) -> DataFrame:
        if marks.limit(FILTERED + 1).count() <= FILTERED:
            marks = F.broadcast(marks)
        return rows.join(marks, F.col("own_key").eqNullSafe(F.col("key")) & (F.col("own_mark") == F.col("mark")), how)

    once = meet(repeated, "left_semi").dropDuplicates(["own_key", "own_mark"])
    return meet(gone.union(repeated), "left_anti").select("row.*").union(once.select("row.*"))
