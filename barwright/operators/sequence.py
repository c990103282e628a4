"""Ordered-window building blocks that never put a whole series into one task.

A window ordered by time and partitioned by the series key alone sends a series that holds a third
of all rows to a single task. Every ordered operator here first cuts the series into chunks of
bounded span and carries across the chunk edges just what its frames can see.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

CHUNK = "_chunk"
CORE = "_core"


def chunk_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def with_index_halo(df: DataFrame, index: str, size: int, before: int, after: int) -> DataFrame:
    """Copy rows near a chunk edge into the neighbouring chunk.

    `index` is an integer clock (bars since the epoch). A frame that looks back at most `before`
    ticks and ahead at most `after` ticks of that clock sees in its chunk just what it would see in
    the whole series. Rows with _core false are the copies and must be dropped after the windows.
    """
    if max(before, after) >= size:
        raise ValueError("chunk size must exceed the halo")
    place = F.pmod(F.col(index), F.lit(size))
    home = F.floor(F.col(index) / F.lit(size)).cast("bigint")
    targets = F.array_compact(F.array(
        home,
        F.when(place >= size - before, home + 1),
        F.when(place < after, home - 1)))
    return (df.withColumn("_home", home)
              .withColumn(CHUNK, F.explode(targets))
              .withColumn(CORE, F.col(CHUNK) == F.col("_home"))
              .drop("_home"))


def core_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORE)).drop(CHUNK, CORE)


def with_row_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, rows: int,
                  carry: Sequence[str], ahead: bool = False) -> DataFrame:
    """Give every chunk the last `rows` rows of the series ahead of it, however far back they lie.

    With `ahead` the first `rows` rows that follow the chunk are given instead. Needed where a
    frame counts rows rather than elapsed time. Only `rows` rows of each chunk travel (a rank limit
    trims them ahead of the shuffle), so the carried table grows with the covered time span, not with
    the row count. `carry` names the columns the frames read; the others are NULL in the copies.
    """
    base = df.withColumn(CHUNK, chunk)
    needed = list(dict.fromkeys([*order, *carry]))
    edge_order = [F.col(c).asc() if ahead else F.col(c).desc() for c in order]
    edges = (base.select(*keys, CHUNK, *needed)
                 .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*edge_order)))
                 .where(F.col("_rank") <= rows)
                 .groupBy(*keys, CHUNK)
                 .agg(F.sort_array(F.collect_list(F.struct(*needed))).alias("_edge")))
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    along = along.rowsBetween(1, rows) if ahead else along.rowsBetween(-rows, -1)
    merged = edges.withColumn("_seen", F.flatten(F.collect_list("_edge").over(along)))
    start = F.lit(1) if ahead else F.greatest(F.size("_seen") - rows + 1, F.lit(1))
    halo = merged.select(*keys, CHUNK, F.explode(F.slice("_seen", start, rows)).alias("_row"))
    copies = halo.select(*keys, CHUNK, *[F.col("_row")[c].alias(c) for c in needed], F.lit(False).alias(CORE))
    return base.withColumn(CORE, F.lit(True)).unionByName(copies, allowMissingColumns=True)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column,
                  name: str) -> DataFrame:
    """Latest non-null `value` at or before each row, over the whole series."""
    base = df.withColumn(CHUNK, chunk).withColumn("_value", value)
    ends = base.where(F.col("_value").isNotNull()).groupBy(*keys, CHUNK).agg(
        F.max_by("_value", F.struct(*order)).alias("_end"))
    every = base.select(*keys, CHUNK).distinct().join(ends, [*keys, CHUNK], "left")
    along = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    entering = every.withColumn("_entering", F.last("_end", ignorenulls=True).over(along)).drop("_end")
    within = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("_local", F.last("_value", ignorenulls=True).over(within))
    return (local.join(entering, [*keys, CHUNK], "left")
                 .withColumn(name, F.coalesce("_local", "_entering"))
                 .drop(CHUNK, "_value", "_local", "_entering"))


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """1-based position of each row in its series: position in the chunk plus the rows ahead of it."""
    base = df.withColumn(CHUNK, chunk)
    sizes = base.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    return (base.withColumn("_place", F.row_number().over(chunk_window(keys, order)))
                .join(offsets, [*keys, CHUNK])
                .withColumn(name, (F.col("_place") + F.col("_offset")).cast("bigint"))
                .drop(CHUNK, "_place", "_offset"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, starts: Column,
            name: str) -> DataFrame:
    """Label each row with the ordering value at which its run began (gaps and islands)."""
    return carry_forward(df, keys, order, chunk, F.when(starts, F.col(order[0])), name)


def balanced_chunk(df: DataFrame, keys: Sequence[str], time: str, tiebreak: str, cell_micros: int,
                   target: int = 1_000_000, name: str = "_slab") -> DataFrame:
    """An order-preserving chunk of about `target` rows per series, for feeds whose rows may pile up in time.

    Rows are counted per time cell first (partial aggregates; the cell table is bounded by the span), the
    running count cuts the series into slabs, and a single instant that alone outgrows a slab is cut
    further along the tiebreak. The result orders like (time, tiebreak).
    """
    cell = F.floor(F.unix_micros(time) / F.lit(cell_micros)).cast("bigint")
    base = df.withColumn("_cell", cell)
    cells = base.groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), (F.min(time) == F.max(time)).alias("_instant"))
    along = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    heavy = F.col("_instant") & (F.col("_n") > target)
    # A heavy cell opens its own slab, so that its cuts never mix with a neighbouring cell.
    turns = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_heavy", F.coalesce(heavy, F.lit(False)))
    cells = cells.withColumn("_turn", F.sum(F.when(F.col("_heavy"), 2).otherwise(0)).over(turns)
                             - F.when(F.col("_heavy"), 1).otherwise(0))
    cells = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"),
                         (F.floor(F.col("_ahead") / target)).alias("_part"), "_turn", "_heavy")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on.append(F.col("_cell").eqNullSafe(F.col("_c")))
    cut = F.when(F.col("_heavy"), F.floor(F.col(tiebreak) / target)).otherwise(F.lit(0)).cast("bigint")
    return base.join(cells, on, "left").withColumn(name, F.struct("_part", "_turn", cut.alias("_cut"))).select(
        *df.columns, name)


def salted_join(rows: DataFrame, groups: DataFrame, on: Sequence[str], spread_by: str, how: str = "left",
                salts: int = 16) -> DataFrame:
    """Join rows to a table with one row per group without sending a hot group to one task.

    The group table is repeated once per salt; every row asks for the copy its own hash names.
    """
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
