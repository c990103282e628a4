"""Sums of many overlapping groups of the same rows, without a row per group.

Thirty hypotheses that each choose a third of the rows would make ten rows of every row. Here a task adds a batch up for one group after the
other, by the codes of its keys, and hands on one row per group and combination of keys; Spark adds these up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Rows that are added up together.
BATCH = 65_536


def tallies(rows: DataFrame, keys: Sequence[str], groups: Sequence[str], counts: Sequence[str], sums: Sequence[str],
            measure: Callable[[Mapping[str, np.ndarray], int], Iterable[tuple[np.ndarray, Mapping[str, np.ndarray | None]]]], name: str = "hypothesis") -> DataFrame:
    """One row per combination of keys (texts) and group with the named counts and sums.

    `measure` gets the other columns of a batch as arrays (missing numbers as NaN) and the number of a group, and tells positions of the batch
    and, per name, the values there; None counts the positions, NaN adds nothing. Groups and keys are few (a fixed list, sessions, regimes):
    a task holds a number per group, name and combination of keys. Combinations for which everything is zero are absent.
    """
    names = [*counts, *sums]
    others = [c for c in rows.columns if c not in keys]
    number, place_of, key_count, batch_size = len(groups), {n: j for j, n in enumerate(names)}, len(keys), BATCH
    listed = list(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        held = np.zeros((number, len(names), 256))

        def add(some: list[pa.RecordBatch]) -> None:
            nonlocal held
            table = pa.Table.from_batches(some).combine_chunks()
            code, texts = np.zeros(table.num_rows, np.int64), []
            for column in table.columns[:key_count]:
                coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
                coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
                code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
                texts.append(coded.dictionary.to_pylist())
            found, code = np.unique(code, return_inverse=True)
            own = []
            for one in found.tolist():
                key = []
                for words in reversed(texts):
                    one, at = divmod(one, len(words))
                    key.append(words[at])
                own.append(known.setdefault(tuple(reversed(key)), len(known)))
            if len(known) > held.shape[2]:
                wider = np.zeros((number, len(names), 2 * len(known)))
                wider[:, :, :held.shape[2]] = held
                held = wider
            own = np.array(own, np.int64)
            columns = {c: table.column(key_count + j).to_numpy() for j, c in enumerate(others)}
            for i in range(number):
                for at, values in measure(columns, i):
                    here = code[at]
                    for name_, value in values.items():
                        if value is not None and value.dtype != bool and np.isnan(value.sum()):
                            value = np.where(np.isnan(value), 0.0, value)
                        held[i, place_of[name_], own] += np.bincount(here, value, len(own))

        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.num_rows
            if size >= batch_size:
                add(some)
                some, size = [], 0
        if size:
            add(some)
        if known:
            told = list(zip(*known)) if key_count else []
            for i in range(number):
                full = np.flatnonzero((held[i, :, :len(known)] != 0).any(axis=0))
                yield pa.RecordBatch.from_arrays([*[pa.array([column[j] for j in full], pa.string()) for column in told], pa.array([listed[i]] * len(full), pa.string()),
                                                  *[pa.array(held[i, j, full]) for j in range(len(names))]], names=[*[f"k{j}" for j in range(key_count)], "g", *[f"m{j}" for j in range(len(names))]])

    kinds = ", ".join([*[f"k{j} string" for j in range(key_count)], "g string", *[f"m{j} double" for j in range(len(names))]])
    parts = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], *others).mapInArrow(run, kinds)
    out = parts.groupBy(*[F.col(f"k{j}").alias(k) for j, k in enumerate(keys)], F.col("g").alias(name))
    return out.agg(*[F.sum(f"m{j}").cast("bigint" if n in counts else "double").alias(n) for j, n in enumerate(names)])
