"""Document fingerprints by winnowing.

Method: a polynomial hash of every k code points, rolled along the text; of every w neighbouring hashes the least one is kept,
the rightmost where several are least, together with its position. Any passage of at least k + w - 1 code points that two
texts share therefore gives both texts a common fingerprint, wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barwright.llm.common import batch_of, map_arrow

# Code points of one gram, and hashes of one window: passages of 12 + 12 - 1 code points are always found, so a text of 45 that
# keeps its first half is always alike in part.
GRAM, WINDOW = 12, 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
# Text bytes one bucket of neighbouring ids should hold, and the most buckets there are.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 16_384


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, by doubling: the hash of 2m values follows from two hashes of m."""
    total, start, done = None, 0, 0
    block = points.astype(np.uint64) + np.uint64(1)
    power, width, left = _BASE, 1, k
    count = len(points) - k + 1
    while left:
        if left & 1:
            part = block[done:done + count]
            total = part if total is None else total * power + part
            done += width
        left >>= 1
        if left:
            block = block[:-width] * power + block[width:]
            width *= 2
            power = power * power
    total = total ^ (total >> np.uint64(32))
    total = total * _MIX
    return total ^ (total >> np.uint64(29))


def window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost least hash of every w neighbours, each once, ascending."""
    value, at, width = hashes, np.arange(len(hashes), dtype=np.int64), 1
    w = min(w, len(hashes))
    while width < w:
        step = min(width, w - width)
        right = value[step:] <= value[:-step]
        at = at[:-step] + (at[step:] - at[:-step]) * right
        value = np.minimum(value[step:], value[:-step])
        width += step
    # The rightmost least hash never moves back from one window to the next.
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def fingerprint_of(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (unsigned 64 bit) and their positions. A text of fewer than k code points is one gram; an empty text has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = gram_hashes(points, min(k, len(points)))
    at = window_minima(hashes, w)
    return hashes[at], at


def fingerprint(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Rows (key, hashes array<bigint>, positions array<bigint>), one per input row; a null text counts as empty.

    Repeated keys stay separate rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(value or "", k, w) for value in batch.column(1).to_pylist()]
            yield batch_of((key, "hashes", "positions"), (batch.column(0), pa.array([h.view(np.int64) for h, _ in found], type=pa.list_(pa.int64())),
                                                           pa.array([p for _, p in found], type=pa.list_(pa.int64()))))

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, hashes array<bigint>, positions array<bigint>")


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Common share of two sets of kept hashes; two empty sets are alike."""
    return common_share(distinct(one), distinct(other))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; np.unique takes several times as long for whole numbers."""
    hashes = np.sort(hashes)
    return hashes[np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[:len(hashes)])]


def common_share(one: np.ndarray, other: np.ndarray) -> float:
    """`likeness` of hashes that are sorted and distinct already."""
    if not len(one) and not len(other):
        return 1.0
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common / (len(one) + len(other) - common)


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    """Kept grams as text: the low half of each hash and its distance from the gram before, in hex."""
    if not len(at):
        return ""
    halves = (hashes & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex(" ", 4).split(" ")
    # Distances are window lengths at most, so few of them are spelled out.
    apart = np.diff(at, prepend=0)
    spelled = [f"+{distance:x}" for distance in range(apart.max() + 1)]
    return " ".join(map(str.__add__, halves, map(spelled.__getitem__, apart.tolist())))


def id_bounds(df: DataFrame, key: str, text: str) -> list[int]:
    """Upper bounds that cut the keys into buckets of about equal numbers of rows; at most MOST_BUCKETS values reach the driver."""
    size = df.agg(F.sum(F.octet_length(text)).alias("bytes")).first()["bytes"] or 0
    count = max(1, min(MOST_BUCKETS, int(size // BUCKET_BYTES)))
    bounds = df.agg(F.percentile_approx(key, [i / count for i in range(1, count)], 10 * count).alias("bounds")).first()["bounds"] if count > 1 else None
    return sorted(set(bounds or []))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key, by binary search in a constant array; a null key comes last (bucket -1)."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) < key), at + step).otherwise(at))
    return F.when(key.isNull(), -1).otherwise(found)


def next_in_order(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows dealt by buckets of neighbouring keys, one row per bucket naming the bucket that follows it in descending order).

    The first row of each bucket is also given to the bucket before it, marked as a guest, so that every row finds its successor
    in its own bucket; the texts are shuffled once.
    """
    bounds = id_bounds(df, key, text)
    rows = df.select(F.col(key), F.col(text), bucket_of(F.col(key), bounds).alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.max(key).alias("head")).collect()
    order = sorted((row["bucket"], row["head"]) for row in heads)
    order = order[::-1]
    # The bucket after the last is the first again.
    guest_of = {order[i][0]: order[i - 1][0] for i in range(len(order))}
    return rows, guest_of, dict(order)


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in descending order of the key.

    The edited text: its last floor(n/2) code points give way to as many first ones (or all) of the next document; after the last
    document comes the first. Null texts are empty. Documents of one key are ordered by their text; a null key comes last. One
    document alone is its own next. Empty table: no rows.
    """
    df = df.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    rows, guest_of, heads = next_in_order(df, key, text)
    if not heads:
        moved = rows.withColumn("guest", F.lit(False))
    else:
        numbers = sorted(heads)
        hosts = F.split(F.lit(",".join(str(guest_of[b]) for b in numbers)), ",").cast("array<bigint>")
        tops = F.split(F.lit(",".join("" if heads[b] is None else str(heads[b]) for b in numbers)), ",")
        at = F.array_position(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>"), F.col("bucket").cast("bigint")).cast("int") - 1
        top = F.get(tops, at)
        # Every row of the head key travels as a guest; the one that sorts first is the successor.
        is_head = F.when(F.col(key).isNull(), top == "").otherwise(F.col(key).cast("string") == top)
        own = F.struct(F.col("bucket").cast("bigint").alias("to"), F.lit(False).alias("guest"))
        copy = F.struct(F.get(hosts, at).alias("to"), F.lit(True).alias("guest"))
        moved = rows.withColumn("go", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own)))).select(
            F.col("go.to").alias("bucket"), F.col("go.guest").alias("guest"), key, text)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(heads) // 2, 8192), 1)
    moved = moved.repartition(parts, "bucket").sortWithinPartitions(F.col("bucket"), F.col("guest"), F.col(key).desc_nulls_last(), F.col(text))
    names = (key, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[list] = [[] for _ in names]

        def finish(row, following) -> None:
            """One document, now that its successor is known."""
            number, own, marks, kept = row
            keep = len(own) - len(own) // 2
            edited = own[:keep] + following[1][:len(own) // 2]
            changed = fingerprint_of(edited, k, w)
            values = (number, len(own), edited, written(*marks), written(*changed), common_share(kept, distinct(changed[0])), common_share(kept, following[3]))
            for column, value in zip(out, values):
                column.append(value)

        for batch in batches:
            for bucket, guest, number, own in zip(*(column.to_pylist() for column in batch.columns)):
                marks = fingerprint_of(own, k, w)
                row = (number, own, marks, distinct(marks[0]))
                if held is not None and held[0] == bucket and not held[1]:
                    finish(held[2], row)
                held = (bucket, guest, row)
            if len(out[0]) >= 128:
                yield packed(out)
                out = [[] for _ in names]
        if out[0]:
            yield packed(out)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def packed(out: list[list]) -> pa.RecordBatch:
        return batch_of(names, [pa.array(column, type=kind) for column, kind in zip(out, kinds)])

    return map_arrow(moved.select("bucket", "guest", key, text), run, f"`{key}` bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
