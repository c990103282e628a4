"""Ranked lexical search by dense blocked matrix products.

Method: the items of a block are cut into tiles, and a tile keeps the columns of its own terms only. Documents become rows of
(term, occurrences) over the vocabulary of the block, once; a tile of them becomes a dense matrix of impacts. The scores of an item tile
over a document tile are products of its weights and those impacts in float64. Weights and impacts are whole numbers, and the columns
of a tile are cut so that no partial sum reaches 2^53: sums are exact in any order, and the cuts are added up in 64-bit integers. Per tile
and item the best are kept with all ties at the limit settled by the key, so the best of all tiles are the best of all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from barwright.llm.common import batch_of, map_arrow
from barwright.session import materialize

BEST = 50
# Items and bytes of item texts of one block, whose vocabulary travels with the tasks; larger query sets take several passes.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 8 << 20
# Items and documents of one tile; columns multiplied at once.
ITEMS, DOCUMENTS, COLUMNS = 256, 512, 4096
EXACT, LARGEST = 1 << 53, (1 << 63) - 1
# Shares of an item's candidates that are ranked before all of them are.
SHARES = 64
# Letters of ASCII are lowered, other ASCII signs part terms, every byte above ASCII belongs to a term.
_FOLD = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def term_rows(df: DataFrame, vocabulary: list[bytes], text: str, key: str) -> DataFrame:
    """(key, n, ids, times) per row: all terms of the text counted, and the occurrences of those in the vocabulary (32-bit integers)."""
    place = {term: i for i, term in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ids, times = [], [], []
            for value in batch.column(1).to_pylist():
                own = terms(value)
                found = Counter(map(place.get, own))
                found.pop(None, None)
                size.append(len(own))
                ids.append(np.fromiter(found, dtype="<u4", count=len(found)).tobytes())
                times.append(np.fromiter(found.values(), dtype="<u4", count=len(found)).tobytes())
            yield batch_of((key, "n", "ids", "times"), (batch.column(0), pa.array(size, type=pa.int64()), pa.array(ids, type=pa.binary()), pa.array(times, type=pa.binary())))

    return map_arrow(df.select(F.col(key).cast("bigint").alias(key), text), run, f"`{key}` bigint, n bigint, ids binary, times binary")


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; tasks count first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4"), minlength=size)
        held = np.flatnonzero(counts)
        yield batch_of(("term", "held"), (pa.array(held), pa.array(counts[held])))

    out = np.zeros(size, np.int64)
    for row in rows.select("ids").mapInArrow(run, "term bigint, held bigint").groupBy("term").agg(F.sum("held").alias("held")).collect():
        out[row["term"]] = row["held"]
    return out


def cuts(weights: np.ndarray, largest: int) -> list[tuple[int, int]]:
    """Ranges of columns whose products sum to less than 2^53 for every row of weights, and of at most COLUMNS columns."""
    out, start = [], 0
    while start < weights.shape[1]:
        sums = np.cumsum(weights[:, start:start + COLUMNS], axis=1).max(axis=0) * largest
        end = start + max(1, int(np.searchsorted(sums, EXACT)))
        out.append((start, end))
        start = end
    return out


def best_rows(score: np.ndarray, key: np.ndarray, best: int) -> np.ndarray:
    """Numbers of the rows of highest score above 0, equal scores by ascending key."""
    some = np.flatnonzero(score > 0)
    if len(some) > best:
        limit = np.partition(score[some], len(some) - best)[len(some) - best]
        # Every row at the limit is kept until the key has settled the tie.
        some = some[score[some] >= limit]
    return some[np.lexsort((key[some], -score[some]))[:best]]


class Tile:
    """Some items, their weights, and the vocabulary numbers of their columns."""

    def __init__(self, items: list[int], own: list[np.ndarray], weight: np.ndarray, largest: int):
        self.items = items
        self.columns = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        self.weights = np.zeros((len(items), len(self.columns)))
        for row, held in enumerate(own):
            self.weights[row, np.searchsorted(self.columns, held)] = weight[held]
        self.cuts = cuts(self.weights, largest)

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
        """Items x documents, from the impacts of the document rows' terms."""
        at = np.minimum(np.searchsorted(self.columns, term), max(0, len(self.columns) - 1))
        inside = self.columns[at] == term if len(self.columns) else np.zeros(len(term), bool)
        row, at, impact = row[inside], at[inside], impact[inside]
        out = np.zeros((len(self.items), rows), np.int64)
        for start, end in self.cuts:
            here = (at >= start) & (at < end)
            # Only columns that the documents of this tile hold.
            used, column = np.unique(at[here], return_inverse=True)
            if len(used):
                dense = np.zeros((len(used), rows))
                dense[column, row[here]] = impact[here]
                out += (self.weights[:, used] @ dense).astype(np.int64)
        return out


def ranked(rows: DataFrame, tiles: list[Tile], documents: int, total: int, key: str, best: int) -> DataFrame:
    """(item, key, score): the best documents of every task for each item of the block."""
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per item: scores, keys, missing keys of the best so far.
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def tile_of(batch: pa.RecordBatch) -> None:
            missing = np.asarray(batch.column(0).is_null())
            keys = batch.column(0).fill_null(none).to_numpy()
            ids = batch.column(2).to_pylist()
            row = np.repeat(np.arange(len(ids)), [len(one) // 4 for one in ids])
            term = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
            times = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<u4").astype(np.int64)
            length = 50 + (50 * batch.column(1).to_numpy() * documents) // total
            impact = (1_000_000_000 * times) // (1000 * times + 20 * length[row])
            for tile in tiles:
                scores = tile.scores(row, term, impact, len(ids))
                # Below the least of an item's best nothing can enter.
                limit = np.array([int(held[item][0][-1]) if item in held and len(held[item][0]) == best else 1 for item in tile.items])
                for at in np.flatnonzero((scores >= limit[:, None]).any(axis=1)).tolist():
                    item, own = tile.items[at], np.where(scores[at] >= limit[at], scores[at], 0)
                    some = best_rows(own, keys, best)
                    found = (own[some], keys[some], missing[some])
                    if item in held:
                        found = tuple(np.concatenate(both) for both in zip(held[item], found))
                        keep = best_rows(found[0], found[1], best)
                        found = tuple(one[keep] for one in found)
                    held[item] = found

        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS):
                tile_of(batch.slice(start, DOCUMENTS))
        for item, (scores, keys, missing) in held.items():
            yield batch_of(("item", key, "score"), (pa.array(np.full(len(keys), item)), pa.array(keys, mask=missing), pa.array(scores)))

    return rows.mapInArrow(run, f"item bigint, `{key}` bigint, score bigint")


def top(found: DataFrame, by: list[str], key: str, best: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", best: int = BEST) -> DataFrame:
    """(item, rank, key, score): the best documents of every item, score above 0, highest first, equal scores by ascending key.

    An item is a value of `item`; rows that share it give their terms together, once each, and null is a value too. Items without a
    term, or whose terms no document holds, have no row. Every row of docs is a document of its own, repeated and null keys too; null
    keys come after all others among equal scores. Null and empty texts count as no document. Other columns are not read.
    Items are taken in blocks of bounded size by a hash of their number, documents are read once per block.
    Needs 50 * n * N (terms of the longest document, number of documents) below 2^63, and fails beyond.
    """
    spark = docs.sparkSession
    size = items.agg(F.countDistinct(item).alias("items"), F.sum(F.octet_length(item_text)).alias("bytes")).first()
    blocks = max(1, -(-(size["items"] + 1) // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        own: dict[int | None, set[bytes]] = {}
        for row in items.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == block).select(F.col(item).cast("bigint"), item_text).collect():
            own.setdefault(row[0], set()).update(terms(row[1]))
        names = sorted((name for name, held in own.items() if held), key=lambda name: (name is None, name or 0))
        found = block_search(docs, names, [own[name] for name in names], text, key, best)
        # Numbers of a block become item keys again; a block is bounded, so is this table.
        known = spark.createDataFrame([Row(item=i, name=name) for i, name in enumerate(names)], "item bigint, name bigint")
        found = found.join(F.broadcast(known), "item").select(F.col("name").alias(item), "rank", key, "score")
        out = found if out is None else out.union(found)
    return out


def block_search(docs: DataFrame, names: list, own: list[set[bytes]], text: str, key: str, best: int) -> DataFrame:
    vocabulary = sorted(set().union(*own))
    place = {term: i for i, term in enumerate(vocabulary)}
    rows = materialize(term_rows(docs, vocabulary, text, key))
    sizes = rows.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total"), F.max("n").alias("longest")).first()
    documents, total = sizes["documents"], sizes["total"] or 1
    if 50 * (sizes["longest"] or 0) * documents > LARGEST:
        raise OverflowError("50 * terms of the longest document * documents passes 63 bits")
    held = document_counts(rows, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], dtype=np.int64)
    # An impact is below 10^9 / 1000.
    columns = [np.array(sorted(map(place.__getitem__, one)), dtype=np.int64) for one in own]
    # Items that share terms stand together, so that tiles have few columns.
    order = sorted(range(len(names)), key=lambda i: columns[i].tolist())
    tiles = [Tile(order[at:at + ITEMS], [columns[i] for i in order[at:at + ITEMS]], weight, 1_000_000) for at in range(0, len(order), ITEMS)]
    found = ranked(rows.where("octet_length(ids) > 0"), tiles, documents, total, key, best)
    found = found.withColumn("share", F.pmod(F.xxhash64(key, "score"), F.lit(SHARES)))
    return top(top(found, ["item", "share"], key, best), ["item"], key, best).drop("share")
