"""Exact, linearly interpolated quantiles of unbounded columns.

The built-in exact percentile keeps every distinct value of a group in one task. Here the value range
is narrowed in rounds of counting: a fixed order-preserving logarithmic cell, then a linear slice of
the cell that holds the wanted rank, then the distinct values of that slice. Each round ships counts
only, pre-aggregated on the map side, and the tables in between have a size fixed by the cell grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barwright.session import materialize

CELLS_PER_E = 512
CELL_SHIFT = 400_000
SLICES = 1024


def _cell(value: Column) -> Column:
    size = (F.floor(F.log(F.abs(value)) * CELLS_PER_E) + CELL_SHIFT).cast("bigint")
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, size).otherwise(-size)


def _locate(counts: DataFrame, group: Sequence[str], place: str, targets: DataFrame, rank: str, small: bool) -> DataFrame:
    """The row of `counts` whose cumulated range holds the target rank; the rank becomes local to it."""
    along = Window.partitionBy(*group).orderBy(place)
    placed = counts.withColumn("_upto", F.sum("_n").over(along)).withColumn("_from", F.col("_upto") - F.col("_n"))
    asked = targets.withColumnRenamed(rank, "_asked").withColumnsRenamed({g: f"_t{g}" for g in group})
    asked = F.broadcast(asked) if small else asked
    inside = (F.col("_asked") >= F.col("_from")) & (F.col("_asked") < F.col("_upto"))
    hit = placed.join(asked, [*[F.col(g).eqNullSafe(F.col(f"_t{g}")) for g in group], inside])
    return (hit.withColumn(rank, F.col("_asked") - F.col("_from"))
               .drop("_n", "_upto", "_from", "_asked", *[f"_t{g}" for g in group]))


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, fan: str | None = None, fan_name: str = "fold",
                    few_groups: bool | None = None, asked: Sequence[tuple] | None = None) -> DataFrame:
    """One row per group with one column per probability, as `quantile_cont` defines it.

    NULLs are skipped; groups with no value are absent. `fan` names an array column of further group
    values a row belongs to (the folds it trains): counts are taken once per distinct array and fan out
    afterwards, so rows are not multiplied by the number of folds. `few_groups` states that the groups
    come from a fixed list (fields, folds, specifications): the rank tables, at most two rows per group and
    probability, are then broadcast and the rows are never shuffled by group. `asked` lists the (value of the first group column, number
    of the probability) pairs that are wanted; the others stay NULL and cost nothing.
    """
    small = not by if few_groups is None else few_groups
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    base = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    keys = [F.col(b).alias(g) for b, g in zip(by, base)] or [F.lit(0).alias("_g0")]
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, *([F.col(fan).alias("_fan")] if fan else []), value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_c", _cell(F.col("_v")))
    group = [*base, "_gf"] if fan else base

    measured = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    if fan:
        sliced = rows.groupBy(*base, "_fan", "_c").agg(*measured).withColumn("_gf", F.explode("_fan"))
        cells = sliced.groupBy(*group, "_c").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    else:
        cells = rows.groupBy(*group, "_c").agg(*measured)
    # The counts are read several times; written down once, each round is a small plan over a table bounded by the grid.
    cells = materialize(cells)
    first = _first(cells, group, base, probs, asked, small)
    picked = first.select(*group, "_c", "_lo", "_hi").distinct()
    slice_no = F.when(F.col("_hi") > F.col("_lo"), F.floor(
        (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (SLICES - 1)).cast("bigint")).otherwise(F.lit(0))
    inside = _join_groups(rows, F.broadcast(picked) if small else picked, [*base, "_c"], fan is not None).withColumn("_s", slice_no)

    values = materialize(inside.groupBy(*group, "_c", "_s", "_v").agg(F.count(F.lit(1)).alias("_n")))
    return _points(values, first, group, names, small).select(*[F.col(g).alias(b) for b, g in zip(by, base)], *([F.col("_gf").alias(fan_name)] if fan else []), *names)


def _first(cells: DataFrame, group: Sequence[str], base: Sequence[str], probs: Sequence[float], asked: Sequence[tuple] | None, small: bool) -> DataFrame:
    """The cells that hold the wanted ranks, with the rank inside of the cell."""
    totals = cells.groupBy(*group).agg(F.sum("_n").alias("_total"))
    wanted = totals.select(*group, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_p"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("_pos"))
        for i, p in enumerate(probs)])).alias("_t"))
    if asked is not None:
        pairs = F.create_map(*[F.lit(x) for first in dict.fromkeys(g for g, _ in asked) for x in (first, F.array(*[F.lit(i) for g, i in asked if g == first]))])
        wanted = wanted.where(F.array_contains(F.element_at(pairs, F.col(base[0])), F.col("_t._p")))
    wanted = wanted.select(*group, F.col("_t._p").alias("_p"),
                           (F.col("_t._pos") - F.floor("_t._pos")).alias("_frac"),
                           F.explode(F.array(
                               F.struct(F.lit(0).alias("_side"), F.floor("_t._pos").alias("_rank")),
                               F.struct(F.lit(1).alias("_side"), F.ceil("_t._pos").alias("_rank")))).alias("_s"))
    wanted = wanted.select(*group, "_p", "_frac", F.col("_s._side").alias("_side"), F.col("_s._rank").alias("_rank"))

    return materialize(_locate(cells, group, "_c", wanted, "_rank", small))


def _points(values: DataFrame, first: DataFrame, group: Sequence[str], names: Sequence[str], small: bool) -> DataFrame:
    """From the distinct values (_c, _s, _v, _n) of the picked cells to one row per group with the interpolated quantiles."""
    slices = values.groupBy(*group, "_c", "_s").agg(F.sum("_n").alias("_n"))
    second = _locate(slices, [*group, "_c"], "_s", first.drop("_lo", "_hi"), "_rank", small)
    third = _locate(values, [*group, "_c", "_s"], "_v", second, "_rank", small)

    ends = third.groupBy(*group, "_p").agg(
        F.max("_frac").alias("_frac"),
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_b"))
    point = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")
    return ends.groupBy(*group).agg(*[F.max(F.when(F.col("_p") == i, point)).alias(n) for i, n in enumerate(names)])


def _join_groups(rows: DataFrame, picked: DataFrame, on: Sequence[str], fan: bool) -> DataFrame:
    """Keep rows whose group was picked. At most two cells per group and probability are picked."""
    other = picked.withColumnsRenamed({c: f"_r{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in on]
    if fan:
        match.append(F.array_contains("_fan", F.col("_gf")))
    return rows.join(other, match).drop(*[f"_r{c}" for c in on], "_fan")


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table of numbers as constants (no join, no shuffle of `df`, and plans stay small).

    The table is computed here, once; NULLs where it has no row. Columns that are not numbers or arrays of numbers are read by a scalar
    subquery instead.
    """
    plain = all(isinstance(field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType, T.NumericType) for field in one_row.schema.fields)
    if not plain:
        packed = one_row.select(F.struct(*one_row.columns).alias("_one"))
        whole = df.withColumn("_one", packed.scalar())
        return whole.select(*df.columns, *[F.col("_one")[c].alias(c) for c in one_row.columns])
    found = one_row.take(2)
    if len(found) > 1:
        raise ValueError("a table of one row was expected")
    values = found[0] if found else [None] * len(one_row.columns)
    return df.select(*df.columns, *[F.lit(value).cast(field.dataType).alias(field.name) for field, value in zip(one_row.schema.fields, values)])


# Bits of a double's order below its cell, and below the slice of a cell.
CELL_BITS, SLICE_BITS, CELL_RANGE = 43, 33, 1 << 20


def column_quantiles(df: DataFrame, groups: Sequence[tuple[str, str, int | None]], probs: Sequence[float], asked: Sequence[tuple], by: Sequence[str] = (),
                     names: Sequence[str] | None = None, bits: str | None = None, fan: str | None = None, fan_name: str = "fold") -> DataFrame:
    """`exact_quantiles` of many groups that are columns of the same rows, without a row per group: (group, *by, fold, *names).

    A group is (name, value column, bit): it holds the rows in which that bit of the column `bits` is set, or all rows (None). Cells and slices
    are the leading bits of a double in its order, so tasks count them without looking at other rows. `by` and `fan` take few values.
    """
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    base = ["_g0", *[f"_g{i + 1}" for i in range(len(by))]]
    group = [*base, "_gf"] if fan else base
    fields = list(dict.fromkeys(column for _, column, _ in groups))
    plan = [(field, [(n, name, bit) for n, (name, column, bit) in enumerate(groups) if column == field]) for field in fields]
    keys = [*base[1:], *(["_fan"] if fan else [])]
    source = df.where(F.size(fan) > 0) if fan else df
    rows = source.select(*[F.col(b).cast("string").alias(g) for b, g in zip(by, base[1:])], *([F.array_join(F.col(fan).cast("array<string>"), ",").alias("_fan")] if fan else []),
                         *([F.col(bits).cast("bigint").alias("_bits")] if bits else []), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(fields)])
    key_count, has_bits, cell_bits, slice_bits, cell_range, batch_size = len(keys), bits is not None, CELL_BITS, SLICE_BITS, CELL_RANGE, 65_536

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.num_rows
            if size >= batch_size:
                yield pa.Table.from_batches(some).combine_chunks()
                some, size = [], 0
        if size:
            yield pa.Table.from_batches(some).combine_chunks()

    def coded(table: pa.Table, known: dict[tuple, int]) -> np.ndarray:
        code, texts = np.zeros(table.num_rows, np.int64), []
        for column in table.columns[:key_count]:
            one = column.combine_chunks().dictionary_encode(null_encoding="encode")
            one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
            code = code * len(one.dictionary) + one.indices.to_numpy(zero_copy_only=False)
            texts.append(one.dictionary.to_pylist())
        found, code = np.unique(code, return_inverse=True)
        own = []
        for one in found.tolist():
            key = []
            for words in reversed(texts):
                one, at = divmod(one, len(words))
                key.append(words[at])
            own.append(known.setdefault(tuple(reversed(key)), len(known)))
        return np.array(own, np.int64)[code]

    def ordered(value: np.ndarray) -> np.ndarray:
        # Doubles as integers of the same order; both zeros are one.
        raw = (value + 0.0).view(np.int64)
        return np.where(raw >= 0, raw, -(raw & np.int64(0x7FFFFFFFFFFFFFFF)))

    def chosen(table: pa.Table, bit: int | None) -> np.ndarray | None:
        return None if bit is None else (table.column(key_count).to_numpy() >> bit) & 1 == 1

    def told(known: dict[tuple, int], at: np.ndarray) -> list[pa.Array]:
        texts = list(zip(*known)) if key_count else []
        return [pa.array(column, pa.string()).take(pa.array(at)) for column in texts]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        held: list[list] = [[] for _ in groups]

        def merged(parts: list) -> list:
            place, n = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
            found, at = np.unique(place, return_inverse=True)
            return [(found, np.bincount(at, n).astype(np.int64))]

        for table in large(batches):
            code = coded(table, known) << 21
            for i, (_, own) in enumerate(plan):
                value = table.column(key_count + has_bits + i).to_numpy()
                there = ~np.isnan(value)
                place = code + (ordered(value) >> cell_bits) + cell_range
                cell = place & (2 * cell_range - 1)
                low = cell.min()
                wide = int(cell.max() - low) + 1
                if wide * len(known) <= 4 * batch_size:
                    # Numbers close to each other need no sorting.
                    at = (place >> 21) * wide + (cell - low)
                    found = (np.arange(len(known))[:, None] << 21 | np.arange(wide) + low).ravel()
                else:
                    found, at = np.unique(place, return_inverse=True)
                for n, _, bit in own:
                    mask = chosen(table, bit)
                    counted = np.bincount(at[there if mask is None else there & mask], minlength=len(found))
                    full = np.flatnonzero(counted)
                    held[n].append((found[full], counted[full]))
                    if sum(len(p) for p, _ in held[n]) > 100_000:
                        held[n] = merged(held[n])
        for n, (name, _, _) in enumerate(groups):
            if held[n]:
                (place, number), = merged(held[n])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(place), pa.string()), *told(known, place >> 21), pa.array((place & (2 * cell_range - 1)) - cell_range), pa.array(number)],
                                                 names=["_g0", *keys, "_c", "_n"])

    texts = "".join(f", {k} string" for k in keys)
    cells = rows.mapInArrow(count, f"_g0 string{texts}, _c bigint, _n bigint")
    folds = F.explode(F.split("_fan", ",")).alias("_gf")
    cells = cells.groupBy("_g0", *keys, "_c").agg(F.sum("_n").alias("_n"))
    if fan:
        cells = cells.select(*base, folds, "_c", "_n").groupBy(*group, "_c").agg(F.sum("_n").alias("_n"))
    cells = materialize(cells)
    first = _first(cells, group, base, probs, asked, True)
    picked = first.select(*group, "_c").distinct()
    # At most two cells per group and probability.
    wanted: dict[str, list] = {}
    for row in picked.collect():
        wanted.setdefault(row["_g0"], []).append((tuple(row[g] for g in base[1:]), row["_gf"] if fan else None, row["_c"]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        sought: list[np.ndarray] = [np.zeros(0, np.int64) for _ in groups]
        for table in large(batches):
            before = len(known)
            code = coded(table, known) << 21
            for key, number in list(known.items())[before:]:
                of, within = (key[:-1], set(key[-1].split(","))) if fan else (key, {None})
                for n, (name, _, _) in enumerate(groups):
                    more = [(number << 21) + c + cell_range for which, fold, c in wanted.get(name, []) if which == of and fold in within]
                    sought[n] = np.unique(np.concatenate([sought[n], np.array(more, np.int64)]))
            for i, (_, own) in enumerate(plan):
                value = table.column(key_count + has_bits + i).to_numpy() + 0.0
                there, order = ~np.isnan(value), ordered(value)
                place = code + (order >> cell_bits) + cell_range
                for n, name, bit in own:
                    if not len(sought[n]):
                        continue
                    mask = chosen(table, bit)
                    hit = there & (sought[n][np.minimum(np.searchsorted(sought[n], place), len(sought[n]) - 1)] == place)
                    at = np.flatnonzero(hit if mask is None else hit & mask)
                    at = at[np.lexsort((order[at], place[at]))]
                    if not len(at):
                        continue
                    starts = np.flatnonzero(np.r_[True, (place[at][1:] != place[at][:-1]) | (order[at][1:] != order[at][:-1])])
                    number, at = np.diff(np.r_[starts, len(at)]), at[starts]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), *told(known, place[at] >> 21), pa.array((place[at] & (2 * cell_range - 1)) - cell_range),
                                                      pa.array((order[at] >> slice_bits) & ((1 << cell_bits - slice_bits) - 1)), pa.array(value[at]), pa.array(number)], names=["_g0", *keys, "_c", "_s", "_v", "_n"])

    values = rows.mapInArrow(gather, f"_g0 string{texts}, _c bigint, _s bigint, _v double, _n bigint").groupBy("_g0", *keys, "_c", "_s", "_v").agg(F.sum("_n").alias("_n"))
    if fan:
        values = values.select(*base, folds, "_c", "_s", "_v", "_n").groupBy(*group, "_c", "_s", "_v").agg(F.sum("_n").alias("_n"))
        other = picked.withColumnsRenamed({c: f"_r{c}" for c in (*group, "_c")})
        values = values.join(F.broadcast(other), [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in (*group, "_c")], "left_semi")
    wide = _points(materialize(values), first, group, names, True)
    return wide.select(F.col("_g0").alias("group"), *[F.col(g).cast(df.schema[b].dataType).alias(b) for b, g in zip(by, base[1:])],
                       *([F.col("_gf").cast(df.schema[fan].dataType.elementType).alias(fan_name)] if fan else []), *names)
