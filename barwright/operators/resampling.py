"""Resampling over effect tables with hashed draws, as plain joins and aggregates.

An effect table has one row per session, so it is small; resamples multiply it. Draws are hashes of
(seed, resample, position): reproducible, order-free and computed where the row is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.hashing import draw_index, hashed_int, uniform
from barwright.operators.sequence import salted_join
from barwright.session import materialize


def positions(effects: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0-based position and size per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return effects.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def _resamples(placed: DataFrame, count: int) -> DataFrame:
    return placed.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def _gather(drawn: DataFrame, placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the drawn effects per resample."""
    source = placed.select(*by, F.col("pos").alias("draw"), F.col("effect").alias("_drawn"))
    return drawn.select(*by, "resample", "draw").join(source, [*by, "draw"]).groupBy(*by, "resample").agg(F.avg("_drawn").alias("mean"))


def session_bootstrap(placed: DataFrame, by: Sequence[str], count: int, seed: Column) -> DataFrame:
    """Sessions drawn with replacement."""
    drawn = _resamples(placed, count).withColumn("draw", draw_index("n", seed, F.col("resample"), F.col("pos")))
    return _gather(drawn, placed, by)


def two_sample_bootstrap(placed: DataFrame, by: Sequence[str], count: int, side: str = "side", first: str = "CONDITIONED") -> DataFrame:
    """Both sides resampled independently; the mean difference per resample. `placed` is positioned per side."""
    means = session_bootstrap(placed, [*by, side], count, F.col(side))
    return means.groupBy(*by, "resample").agg(
        (F.max(F.when(F.col(side) == first, F.col("mean"))) - F.max(F.when(F.col(side) != first, F.col("mean")))).alias("mean"))


def block_size(n: Column) -> Column:
    return F.least(F.lit(20), F.greatest(F.lit(2), F.floor(n / 5)))


def block_bootstrap(placed: DataFrame, by: Sequence[str], count: int, seed: Column, size: Column) -> DataFrame:
    """Moving blocks without wrap-around, cut to the original length."""
    rows = _resamples(placed.withColumn("_b", size.cast("bigint")), count)
    block, offset = F.floor(F.col("pos") / F.col("_b")), F.pmod(F.col("pos"), F.col("_b"))
    start = draw_index(F.col("n") - F.col("_b") + 1, seed, F.col("resample"), block)
    return _gather(rows.withColumn("draw", start + offset), placed, by)


def stationary_bootstrap(placed: DataFrame, by: Sequence[str], count: int, seed: Column, mean_block: Column) -> DataFrame:
    """Circular blocks of geometric length: a restart is hashed per position and the run start is carried forward."""
    rows = _resamples(placed, count)
    restart = (F.col("pos") == 0) | (uniform(seed, F.lit("restart"), F.col("resample"), F.col("pos")) < 1 / mean_block)
    along = Window.partitionBy(*by, "resample").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_start", F.last(F.when(restart, F.col("pos")), ignorenulls=True).over(along))
    first = draw_index("n", seed, F.lit("draw"), F.col("resample"), F.col("_start"))
    drawn = rows.withColumn("draw", F.pmod(first + F.col("pos") - F.col("_start"), F.col("n")))
    return _gather(drawn, placed, by)


def bootstrap_summary(distribution: DataFrame, observed: DataFrame, by: Sequence[str], direction: str = "GREATER") -> DataFrame:
    """Centre, intervals and sign behaviour of a resample distribution (its length is the resample count)."""
    d = distribution.join(observed, list(by))
    mean = F.col("mean")
    favourable = {"GREATER": mean > 0, "LESS": mean < 0}.get(direction, F.abs(mean) > 0)
    q = F.percentile("mean", F.array(*[F.lit(p) for p in (0.025, 0.05, 0.5, 0.95, 0.975)]))
    facts = d.groupBy(*by).agg(F.max("observed").alias("observed"), F.avg("mean").alias("distribution_mean"), q.alias("_q"),
                               F.avg((F.signum(mean) == F.signum("observed")).cast("double")).alias("sign_stability"),
                               F.avg(favourable.cast("double")).alias("favourable"), F.count(F.lit(1)).alias("resamples"))
    names = ("ci95_low", "ci90_low", "median", "ci90_high", "ci95_high")
    return facts.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]).drop("_q")


def _tail(null: DataFrame, observed: DataFrame, by: Sequence[str], direction: str, count: int) -> DataFrame:
    both = null.join(observed, list(by))
    # Resamples that repeat the observation count as extreme, whatever the order of summation did to the last digit.
    near = F.lit(TIE)
    extreme = {"GREATER": F.col("mean") >= F.col("observed") - near, "LESS": F.col("mean") <= F.col("observed") + near}.get(
        direction, F.abs("mean") >= F.abs("observed") - near)
    return both.groupBy(*by).agg(F.max("observed").alias("observed"), F.percentile("mean", F.lit(0.5)).alias("null_median"),
                                 ((F.count_if(extreme) + 1) / F.lit(count + 1)).alias("p_value"))


COINS = 32
TIE = 1e-12


def sign_flip_test(placed: DataFrame, by: Sequence[str], count: int, seed: Column, direction: str = "GREATER") -> DataFrame:
    """Paired permutation: every effect keeps or changes its sign by a hashed coin.

    One hash yields 32 coins, so a row is repeated once per 32 resamples, whose means are 32 columns of one partial aggregate.
    """
    tosses = placed.select(*by, "effect", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // COINS))).alias("_block"), "pos", seed.alias("_seed"))
    tosses = tosses.withColumn("_h", hashed_int("_seed", "_block", "pos"))

    def flipped(bit: int) -> Column:
        tails = F.shiftright("_h", bit).bitwiseAND(F.lit(1)) == 1
        return F.avg(F.when(tails, -F.col("effect")).otherwise(F.col("effect")))
    blocks = tosses.groupBy(*by, "_block").agg(F.array(*[flipped(bit) for bit in range(COINS)]).alias("_means"))
    null = blocks.select(*by, "_block", F.posexplode("_means").alias("_bit", "mean")).where(F.col("_block") * COINS + F.col("_bit") < count)
    observed = placed.groupBy(*by).agg(F.avg("effect").alias("observed"))
    return _tail(null, observed, by, direction, count)


# Bits of one hash, rows added up together, groups that a task holds at once.
BITS, SLICE, HELD = 128, 512, 32


def sign_flip_rows(rows: DataFrame, by: Sequence[str], count: int, seed: str, direction: str = "GREATER") -> DataFrame:
    """`sign_flip_test` for row tables: every bit of md5(seed:block:pos) is the coin of one resample, so a row takes count / 128 hashes.

    A task adds the effects up per byte of the hashes and value of that byte; one product with the bits of all byte values then gives the sums
    of all resamples. Tasks hand on sums per group and resample, never rows. `pos` and `effect` must not be missing; groups may be many, a task
    holds a bounded number of sums.
    """
    blocks = -(-count // BITS)
    kinds = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in by)
    start_of = seed.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = [hashlib.md5(b"%s:%d:" % (start_of, block)) for block in range(blocks)]
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
        place = np.arange(blocks * BITS // 8) * 256
        held: dict[tuple, list] = {}
        types: list[pa.DataType] = []

        def digest(pos: int) -> bytes:
            out, text = [], b"%d" % pos
            for state in begun:
                own = state.copy()
                own.update(text)
                out.append(own.digest())
            return b"".join(out)

        def told() -> pa.RecordBatch:
            arrays = [pa.array(column, type=types[i]) for i, column in enumerate(zip(*held))] if by else []
            # Bit i of a word of 32 bits, the word read as a number, is the coin of resample i.
            tails = [(sums.reshape(-1, 256) @ bits).reshape(-1, 32)[:, ::-1].ravel()[:count] for _, _, sums in held.values()]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.float64()), pa.array(tails, pa.list_(pa.float64()))], names=[*by, "_n", "_total", "_tails"])

        for batch in batches:
            types = types or [column.type for column in batch.columns[:len(by)]]
            keys = list(zip(*(column.to_pylist() for column in batch.columns[:len(by)]))) if by else [()] * batch.num_rows
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                groups.setdefault(key, []).append(i)
            pos, effect = batch.column(len(by)).to_numpy(), batch.column(len(by) + 1).to_numpy().astype(np.float64)
            for key, own in groups.items():
                if key not in held and len(held) >= HELD:
                    yield told()
                    held.clear()
                sums = held.setdefault(key, [0, 0.0, np.zeros(len(place) * 256)])
                for start in range(0, len(own), SLICE):
                    some = own[start:start + SLICE]
                    drawn = np.frombuffer(b"".join(map(digest, pos[some].tolist())), np.uint8).reshape(len(some), -1)
                    sums[2] += np.bincount((drawn + place).ravel(), np.repeat(effect[some], len(place)), len(place) * 256)
                    sums[0] += len(some)
                    sums[1] += float(effect[some].sum())
        if held:
            yield told()

    parts = rows.select(*by, F.col("pos").cast("bigint"), F.col("effect").cast("double")).mapInArrow(run, f"{kinds}{', ' if by else ''}_n bigint, _total double, _tails array<double>")
    # One row per task and group, written down so that rows are hashed once.
    parts = materialize(parts)
    whole = parts.groupBy(*by).agg(F.sum("_n").alias("_n"), F.sum("_total").alias("_total"))
    tails = parts.select(*by, F.posexplode("_tails").alias("resample", "_tail")).groupBy(*by, "resample").agg(F.sum("_tail").alias("_tail"))
    null = tails.join(whole, list(by)).select(*by, "resample", ((F.col("_total") - 2 * F.col("_tail")) / F.col("_n")).alias("mean"))
    return _tail(null, whole.select(*by, (F.col("_total") / F.col("_n")).alias("observed")), by, direction, count)


def label_permutation_test(placed: DataFrame, by: Sequence[str], count: int, seed: Column, side: str = "side",
                           first: str = "CONDITIONED", direction: str = "GREATER") -> DataFrame:
    """Two-sample permutation: a hashed order deals the pooled values into groups of the original sizes."""
    sized = placed.withColumn("_k", F.count_if(F.col(side) == first).over(Window.partitionBy(*by)))
    rows = _resamples(sized, count).withColumn("_u", uniform(seed, F.col("resample"), F.col("pos")))
    deal = Window.partitionBy(*by, "resample").orderBy("_u", "pos")
    dealt = rows.withColumn("_first", F.row_number().over(deal) <= F.col("_k"))
    null = dealt.groupBy(*by, "resample").agg(
        (F.avg(F.when(F.col("_first"), F.col("effect"))) - F.avg(F.when(~F.col("_first"), F.col("effect")))).alias("mean"))
    observed = placed.groupBy(*by).agg(
        (F.avg(F.when(F.col(side) == first, F.col("effect"))) - F.avg(F.when(F.col(side) != first, F.col("effect")))).alias("observed"))
    return _tail(null, observed, by, direction, count)


# ---- multiple testing ------------------------------------------------------------------------------

# Cells of a p-value: linear above, logarithmic below.
CELLS, CELLS_PER_HALVING = 4096, 16


def adjusted_scan(tests: DataFrame, p: str, family: Sequence[str], order: str, method: str, name: str) -> DataFrame:
    """Step-up ("BH") or step-down ("HOLM") adjusted p-values of families of any size, without a window over a family.

    Equal p-values get equal adjusted ones, so counts per distinct p-value suffice. They are cut into cells of p: a running count and a running
    minimum (maximum) inside the cell, and one row per cell that carries the counts of the cells before and the extreme of the cells beyond.
    Of a family only its cells, some twenty thousand at most, meet in one task. A missing p-value has no adjusted one.
    """
    keys = list(family)
    value = F.col(p)
    cell = F.when(value >= 1 / CELLS, F.floor(value * CELLS)).when(value > 0, F.floor(F.log2(value) * CELLS_PER_HALVING)).otherwise(F.lit(-100_000)).cast("bigint")
    distinct = materialize(tests.where(value.isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k")).withColumnRenamed("_p", p).withColumn("_c", cell))
    cells = distinct.groupBy(*keys, "_c").agg(F.sum("_k").alias("_in"))
    whole = Window.partitionBy(*keys)
    cells = cells.withColumn("_before", F.sum("_in").over(whole.orderBy("_c")) - F.col("_in")).withColumn("_n", F.sum("_in").over(whole))
    inside = Window.partitionBy(*keys, "_c").orderBy(p)
    ranked = distinct.join(cells.select(*keys, "_c", "_before", "_n"), [*keys, "_c"]).withColumn("_last", F.col("_before") + F.sum("_k").over(inside))
    if method == "BH":
        # The last of equal p-values has the least ratio.
        ranked = ranked.withColumn("_v", value * F.col("_n") / F.col("_last"))
        local = F.min("_v").over(Window.partitionBy(*keys, "_c").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
        extreme, beyond = F.min("_v"), F.min("_x").over(Window.partitionBy(*keys).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1))
        both = F.least
    else:
        # The first of equal p-values has the largest product.
        ranked = ranked.withColumn("_v", value * (F.col("_n") - (F.col("_last") - F.col("_k"))))
        local = F.max("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        extreme, beyond = F.max("_v"), F.max("_x").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
        both = F.greatest
    ranked = materialize(ranked.withColumn("_local", local))
    carry = ranked.groupBy(*keys, "_c").agg(extreme.alias("_x")).withColumn("_beyond", beyond).select(*keys, "_c", "_beyond")
    table = ranked.join(carry, [*keys, "_c"]).select(*keys, p, F.least(F.lit(1.0), both(F.col("_local"), F.col("_beyond"))).alias(name))
    return salted_join(tests, table, [*keys, p], order)


def planned_scan(tests: DataFrame, p: str, planned: str, family: Sequence[str], order: str) -> DataFrame:
    """`planned_penalty` for families of any size."""
    within = tests.withColumn("within_p", F.least(F.lit(1.0), F.col(p) * F.col(planned)))
    return adjusted_scan(within, "within_p", family, order, "BH", "adjusted_p")


def benjamini_hochberg(tests: DataFrame, p: str, family: Sequence[str], order: str, name: str = "q_value") -> DataFrame:
    """Step-up adjusted p-values within a registered family (one row per hypothesis of a fixed list); `adjusted_scan` takes any size."""
    up = Window.partitionBy(*family).orderBy(p, order)
    ranked = tests.withColumn("_r", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    down = Window.partitionBy(*family).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))).drop("_r", "_n")


def holm(tests: DataFrame, p: str, family: Sequence[str], order: str, name: str = "holm_p") -> DataFrame:
    """Step-down adjusted p-values within a family."""
    up = Window.partitionBy(*family).orderBy(p, order)
    ranked = tests.withColumn("_r", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    along = Window.partitionBy(*family).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_n") - F.col("_r") + 1)).over(along))).drop("_r", "_n")


def planned_penalty(tests: DataFrame, p: str, planned: str, family: Sequence[str], order: str) -> DataFrame:
    """Within-hypothesis penalty for planned comparisons, then step-up adjustment across the registry."""
    within = tests.withColumn("within_p", F.least(F.lit(1.0), F.col(p) * F.col(planned)))
    return benjamini_hochberg(within, "within_p", family, order, "adjusted_p")
