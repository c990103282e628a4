"""Vector codes by product quantisation, trained with member-resident Lloyd rounds in whole numbers.

Method: every part of every vector lives in the partition of its owner (position, entry, salt). In a round the owners sum their
resident members, the sums give the new codebook, and each member looks for its nearest entry where it is. Those that keep their
entry stay in their partition, untouched by any exchange; only the ones whose entry changes are sent to their new owner in the next
shuffle. Residents and arrivals are laid together partition by partition. The salt is a hash of the row, so the members of an entry
spread over all partitions, however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from barwright.llm.common import batch_of
from barwright.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Whole numbers below these are exact in float64, and fit 63 bits.
EXACT, LARGEST = 1 << 53, 1 << 63
# Members of one block, and of one comparison with a codebook.
BLOCK = 8192
# (position, entry, row number, components) of some members.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and the squared distance, ties to the lower index; exact."""
    if 3 * part.shape[1] * int(max(np.abs(part).max(initial=0), np.abs(entries).max(initial=0))) ** 2 < EXACT:
        a, b = part.astype(np.float64), entries.astype(np.float64)
        distance = (b * b).sum(axis=1) - 2 * (a @ b.T)
        chosen = distance.argmin(axis=1)
    else:
        chosen, least = np.zeros(len(part), np.int64), np.full(len(part), np.iinfo(np.int64).max)
        for number, entry in enumerate(entries):
            distance = ((part - entry) ** 2).sum(axis=1)
            closer = distance < least
            chosen[closer], least[closer] = number, distance[closer]
    return chosen, ((part - entries[chosen]) ** 2).sum(axis=1)


def joined(blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, Block]]:
    """Small blocks of one partition, laid together up to BLOCK members."""
    some: dict[int, list[Block]] = {}
    held: dict[int, int] = {}
    for owner, block in blocks:
        some.setdefault(owner, []).append(block)
        held[owner] = held.get(owner, 0) + len(block[0])
        if held[owner] >= BLOCK:
            yield owner, tuple(np.concatenate(column) for column in zip(*some.pop(owner)))
            del held[owner]
    for owner, own in some.items():
        yield owner, tuple(np.concatenate(column) for column in zip(*own))


def owner_of(position: np.ndarray, entry: np.ndarray, row: np.ndarray, partitions: int) -> np.ndarray:
    """Partition of the owner (position, entry, salt); the salt of a row is one of as many as there are partitions."""
    mixed = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    salt = (mixed ^ (mixed >> np.uint64(32))) % np.uint64(partitions)
    return ((salt + (position * ENTRIES + entry).astype(np.uint64)) % np.uint64(partitions)).astype(np.int64)


def divided(block: Block, owner: np.ndarray) -> Iterator[tuple[int, Block]]:
    """The members of a block, by owner."""
    order = np.argsort(owner, kind="stable")
    at = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for members in np.split(order, at[1:]) if len(order) else ():
        yield int(owner[members[0]]), tuple(column[members] for column in block)


def placed(position: np.ndarray, part: np.ndarray, book: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and distances of members of any positions."""
    entry, distance = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for p, entries in enumerate(book):
        own = np.flatnonzero(position == p)
        for start in range(0, len(own), BLOCK):
            some = own[start:start + BLOCK]
            entry[some], distance[some] = nearest(part[some], entries)
    return entry, distance


def kept(rdd: RDD) -> RDD:
    """Computed once and written to the shared folder, so that lost executors cost no round."""
    rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    rdd.count()
    rdd.unpersist()
    return rdd


def updated(state: RDD, book: list[np.ndarray]) -> list[np.ndarray]:
    """Floors of the means of all members per entry; owners sum their residents, entries without members stay."""
    width = book[0].shape[1]

    def own(blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        count, total = np.zeros(PARTS * ENTRIES, np.int64), np.zeros((PARTS * ENTRIES, width), np.int64)
        for _, (position, entry, _, part) in joined(blocks):
            at = position * ENTRIES + entry
            count += np.bincount(at, minlength=len(count))
            order = np.argsort(at, kind="stable")
            start = np.flatnonzero(np.diff(at[order], prepend=-1))
            total[at[order][start]] += np.add.reduceat(part[order], start, axis=0)
        for at in np.flatnonzero(count).tolist():
            yield at, (int(count[at]), total[at])

    sums = state.mapPartitions(own).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), min(state.getNumPartitions(), PARTS * ENTRIES))
    new = [entries.copy() for entries in book]
    # One row per entry: PARTS * ENTRIES at most.
    for at, (count, total) in sums.collect():
        new[at // ENTRIES][at % ENTRIES] = total // count
    return new


def moved(state: RDD, book: list[np.ndarray], partitions: int) -> RDD:
    """The state after every member has looked for its nearest entry: residents stay where they are, the others are shuffled to their owners."""
    def look(blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, tuple[int, Block]]]:
        for home, (position, entry, row, part) in joined(blocks):
            new, _ = placed(position, part, book)
            stays = new == entry
            if stays.any():
                yield home, (home, (position[stays], entry[stays], row[stays], part[stays]))
            gone = ~stays
            goes = (position[gone], new[gone], row[gone], part[gone])
            for target, block in divided(goes, owner_of(goes[0], goes[1], goes[2], partitions)):
                # A member whose new owner is in the same partition has nowhere to go.
                yield home, (target, block)

    looked = kept(state.mapPartitions(look, preservesPartitioning=True))
    stay = looked.filter(lambda one: one[1][0] == one[0]).mapValues(lambda one: one[1])
    go = looked.filter(lambda one: one[1][0] != one[0]).map(lambda one: one[1]).partitionBy(partitions, int)
    return stay.union(go)


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (key, label, code, error) of all vectors that are kept, and the final codebook: entries x components per part.

    Components become floor(1024 * x). A vector that is null or holds null, NaN or infinite components is dropped. All others need one
    length, a multiple of the number of parts, and components so small that no error passes 63 bits (131,072 at 64 components); other
    tables fail with a message. The codebook starts as the vectors of least key (null keys last, equal keys by their components); with fewer than 256
    vectors it has as many entries. Repeated rows and keys are vectors of their own. `code` has two hex digits per part, `error` is the sum
    of squared distances. An empty table gives no rows and an empty codebook. Other columns are not read.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias(key), F.col(label).alias(label), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("bigint")).alias("v"))
    # Row numbers are fixed once the table is written.
    rows = materialize(rows)
    said = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if said[0] is None:
        return rows.select(key, label, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    if said[0] != said[1] or said[0] % parts:
        raise ValueError(f"vectors need one length, a multiple of {parts}; found {said[0]} to {said[1]}")
    if said[0] * (2 * (said[2] or 0)) ** 2 >= LARGEST:
        raise OverflowError("components so large that squared distances pass 63 bits")
    width = said[0] // parts
    first = rows.orderBy(F.asc_nulls_last(key), "v").select("v").limit(ENTRIES).collect()
    start = np.array([row["v"] for row in first], dtype=np.int64).reshape(len(first), parts, width)
    book = [start[:, p].copy() for p in range(parts)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            yield batch_of(("row", "v"), (pa.array([row.astype("<i8").tobytes()]), pa.array([batch.column(1).flatten().to_numpy().astype("<i8").tobytes()])))

    def settle(read: Iterator, book: list[np.ndarray] = book) -> Iterator[tuple[int, Block]]:
        for one in read:
            row = np.frombuffer(one["row"], "<i8")
            part = np.frombuffer(one["v"], "<i8").reshape(len(row) * parts, width)
            position, row = np.tile(np.arange(parts), len(row)), np.repeat(row, parts)
            entry, _ = placed(position, part, book)
            yield from divided((position, entry, row, part), owner_of(position, entry, row, partitions))

    state = rows.select("row", "v").mapInArrow(blocks, "row binary, v binary").rdd.mapPartitions(settle).partitionBy(partitions, int)
    for number in range(rounds):
        if number:
            state = moved(state, book, partitions)
        book = updated(state, book)

    def final(read: Iterator[tuple[int, Block]]) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
        for _, (position, _, row, part) in joined(read):
            entry, distance = placed(position, part, book)
            yield tuple(bytearray(column.astype("<i8").tobytes()) for column in (row, position, entry, distance))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(("row", "position", "entry", "distance"), [pa.array(np.frombuffer(b"".join(column.to_pylist()), "<i8")) for column in batch.columns])

    found = spark.createDataFrame(state.mapPartitions(final), "row binary, position binary, entry binary, distance binary")
    found = found.mapInArrow(spread, "row bigint, position bigint, entry bigint, distance bigint")
    spelled = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    codes = found.groupBy("row").agg(
        F.concat(*[F.max(F.when(F.col("position") == p, spelled)) for p in range(parts)]).alias("code"), F.sum("distance").alias("error"))
    return rows.select("row", key, label).join(codes, "row").select(key, label, "code", "error"), book


def book_digest(book: list[np.ndarray]) -> str:
    """Of all components by part, entry and position within the part, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for entries in book for x in entries.ravel().tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Rows with label_error, the error summed over all rows of an equal label; null labels together."""
    coded = materialize(coded)
    sums = coded.groupBy(label).agg(F.sum("error").alias("label_error")).select(F.col(label).alias("_label"), "label_error")
    return coded.join(sums, coded[label].eqNullSafe(sums["_label"])).drop("_label")
