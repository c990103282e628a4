"""Hypothesis conditions as boolean columns, with thresholds learned apart from where they are applied."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.hashing import hashed_int
from barwright.operators.quantiles import attach, column_quantiles, exact_quantiles

MINUTE_LIMIT = 270


def threshold_name(field: str, q: float) -> str:
    return f"{field}__q{int(round(q * 1000)):03d}"


def clipped_quantile(q: float, neighbour: float = 0.0) -> float:
    return round(min(0.99, max(0.01, q + neighbour * 0.05)), 6)


def quantile_needs(condition: Mapping, neighbour: float = 0.0) -> set[tuple[str, float]]:
    """The (field, quantile) pairs a condition reads."""
    kind = condition["type"]
    if kind == "all":
        return set().union(*[quantile_needs(c, neighbour) for c in condition["clauses"]])
    if kind.startswith("quantile_"):
        q = condition["quantile"]
        return {(condition["field"], clipped_quantile(q, neighbour) if neighbour else q)}
    return set()


def learn_thresholds(train: DataFrame, needs: set[tuple[str, float]], by: Sequence[str] = (), fan: str | None = None) -> DataFrame | None:
    """All thresholds of a condition set in one pass over the training rows, keyed by `by`.

    With `fan` (an array of the folds each row trains) the result is keyed by fold as well.
    """
    if not needs:
        return None
    fields = sorted({f for f, _ in needs})
    probs = sorted({q for _, q in needs})
    asked, names = [(f, probs.index(q)) for f, q in sorted(needs)], [f"_p{i}" for i in range(len(probs))]
    if by:
        # Groups of rows may be many; only without them are columns counted side by side.
        stacked = train.select(*by, *([fan] if fan else []), F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), F.col(f).cast("double").alias("_value")) for f in fields])))
        table = exact_quantiles(stacked, "_value", probs, by=["_field", *by], names=names, fan=fan, few_groups=True, asked=asked)
    else:
        table = column_quantiles(train, [(f, f, None) for f in fields], probs, asked, names=names, fan=fan).withColumnRenamed("group", "_field")
    keys = [*by, "fold"] if fan else list(by)
    return table.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_field") == f, F.col(f"_p{probs.index(q)}"))).alias(threshold_name(f, q)) for f, q in sorted(needs)])


def condition(spec: Mapping, neighbour: float = 0.0, override: float | None = None) -> Column:
    """Boolean column of a condition; comparisons with missing values are false.

    Quantile clauses read the threshold columns named by `threshold_name`. `override` replaces the
    value, end or quantile of the clause; `neighbour` shifts quantiles by 0.05 and windows by 15 minutes.
    """
    kind = spec["type"]
    if kind == "all":
        out = F.lit(True)
        for clause in spec["clauses"]:
            out = out & condition(clause, neighbour)
        return out
    if kind == "minute_equals":
        out = F.col(spec["field"]) == (spec["value"] if override is None else override)
    elif kind == "minute_range":
        shift = int(neighbour * 15)
        start = max(0, spec["start"] + shift) if neighbour else spec["start"]
        end = spec["end"] if override is None else override
        end = min(MINUTE_LIMIT, end + shift) if neighbour else end
        out = F.col(spec["field"]).between(start, end)
    elif kind in ("quantile_gte", "quantile_lte"):
        q = spec["quantile"] if override is None else override
        limit = F.col(threshold_name(spec["field"], clipped_quantile(q, neighbour) if neighbour else q))
        out = F.col(spec["field"]) >= limit if kind == "quantile_gte" else F.col(spec["field"]) <= limit
    elif kind == "fixed_gte":
        out = F.col(spec["field"]) >= spec["value"]
    elif kind == "fixed_lte":
        out = F.col(spec["field"]) <= spec["value"]
    elif kind == "field_equals":
        out = F.col(spec["field"]) == spec["value"]
    elif kind == "session_hash_mod":
        out = F.pmod(hashed_int("session_id"), F.lit(spec.get("modulus", 10))) == spec.get("remainder", 0)
    else:
        raise ValueError(f"unsupported condition {kind}")
    return F.coalesce(out, F.lit(False))


def bit_sets(rows: DataFrame, kept: Sequence[str], conditions: Sequence[Mapping], sets: Mapping[str, tuple[float, Mapping]], key: str) -> DataFrame:
    """The kept columns and, per set, a bit for every one of up to 63 conditions, of quantile clauses and minute windows, that a row meets.

    A set is (neighbour, thresholds by value of the integer column `key`, one of the kept ones). Written as one expression the conditions make a
    method that the JVM refuses to compile; here each clause is one comparison of a batch, with the rules of `condition`.
    """
    fields = sorted({clause["field"] for spec in conditions for clause in (spec["clauses"] if spec["type"] == "all" else [spec])})
    plan = []
    for name, (n, limits) in sets.items():
        tests = []
        for spec in conditions:
            clauses = []
            for clause in spec["clauses"] if spec["type"] == "all" else [spec]:
                if clause["type"] == "minute_range":
                    shift = int(n * 15)
                    clauses.append((clause["field"], max(0, clause["start"] + shift) if n else clause["start"], min(MINUTE_LIMIT, clause["end"] + shift) if n else clause["end"]))
                elif clause["type"] in ("quantile_gte", "quantile_lte"):
                    learned = threshold_name(clause["field"], clipped_quantile(clause["quantile"], n) if n else clause["quantile"])
                    by_key = {k: np.nan if limit.get(learned) is None else limit[learned] for k, limit in limits.items()}
                    clauses.append((clause["field"], by_key, None) if clause["type"] == "quantile_gte" else (clause["field"], None, by_key))
                else:
                    raise ValueError(f"unsupported condition {clause['type']}")
            tests.append(clauses)
        plan.append((name, tests))
    source = rows.select(*kept, *[F.col(f).cast("double").alias(f"_{f}") for f in fields])
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:len(kept)]], *[f"{name} bigint" for name in sets]])
    names, key_at, kept_count = [*kept, *sets], list(kept).index(key), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, code = np.unique(batch.column(key_at).to_numpy(zero_copy_only=False), return_inverse=True)
            states = {f: batch.column(kept_count + i).to_numpy(zero_copy_only=False) for i, f in enumerate(fields)}

            def bound(limit):
                return np.array([limit.get(k, np.nan) for k in found.tolist()], np.float64)[code] if isinstance(limit, dict) else limit
            out = []
            for _, tests in plan:
                bits = np.zeros(batch.num_rows, np.int64)
                for i, clauses in enumerate(tests):
                    met = np.ones(batch.num_rows, bool)
                    for field, low, high in clauses:
                        if low is not None:
                            met &= states[field] >= bound(low)
                        if high is not None:
                            met &= states[field] <= bound(high)
                    bits |= met.astype(np.int64) << i
                out.append(pa.array(bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept_count], *out], names=names)
    return source.mapInArrow(run, schema)


def with_thresholds(df: DataFrame, train: DataFrame, conditions: Sequence[Mapping], neighbours: Sequence[float] = (0.0,),
                    extra: set[tuple[str, float]] = frozenset()) -> DataFrame:
    """Attach every threshold the conditions need as scalars."""
    needs = set(extra)
    for spec in conditions:
        for n in neighbours:
            needs |= quantile_needs(spec, n)
    table = learn_thresholds(train, needs)
    return df if table is None else attach(df, table)


def signal(spec: Mapping, multiplier: float = 1.0) -> Column:
    """A frozen signal: field against threshold times a multiplier."""
    limit = spec["threshold"] * multiplier
    field = F.col(spec["field"])
    return F.coalesce(field >= limit if spec["operator"] == "gte" else field <= limit, F.lit(False))


def magnitude_factor(spec: Mapping) -> float:
    return 1.25 if spec["field"].startswith("state_return") else 0.75


# Entry policies: name, thresholds learned on train, predicate on test.
POLICIES = ("LOW_COST", "HIGH_SIGNAL_MAGNITUDE", "FAVORABLE_VOLATILITY", "LOW_COST_ATR", "SELECTED_TIME_WINDOW", "RANGE_REGIME")
POLICY_NEEDS = {("state_spread_points", 0.25), ("state_vol_short", 0.25), ("state_vol_short", 0.75), ("cost_atr", 0.25)}


def policy(name: str, spec: Mapping) -> Column:
    if name == "LOW_COST":
        out = F.col("state_spread_points") <= F.col(threshold_name("state_spread_points", 0.25))
    elif name == "HIGH_SIGNAL_MAGNITUDE":
        out = signal(spec, magnitude_factor(spec))
    elif name == "FAVORABLE_VOLATILITY":
        out = F.col("state_vol_short").between(F.col(threshold_name("state_vol_short", 0.25)), F.col(threshold_name("state_vol_short", 0.75)))
    elif name == "LOW_COST_ATR":
        out = F.col("cost_atr") <= F.col(threshold_name("cost_atr", 0.25))
    elif name == "SELECTED_TIME_WINDOW":
        out = F.col("minute").between(60, 210)
    elif name == "RANGE_REGIME":
        out = F.col("state_regime") == "RANGE"
    else:
        raise KeyError(name)
    return F.coalesce(out, F.lit(False))
