"""Null-safe numeric expressions. Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def rounded(value, digits: int = 6) -> Column:
    """Round and fold negative zero, so that results compare by value."""
    return F.round(col(value).cast("double"), digits) + F.lit(0.0)


def ratio(numerator, denominator) -> Column:
    """Division that yields NULL for a zero denominator (ANSI division would raise)."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def unbounded_ratio(numerator, denominator) -> Column:
    """Division by IEEE rules: over zero an infinity of the sign of the numerator, zero over zero NULL (no number)."""
    top, bottom = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when((bottom == 0) & (top != 0), F.signum(top) * float("inf")).otherwise(F.try_divide(top, bottom))


def change(now, before) -> Column:
    """Relative change now/before - 1, NULL when the base is zero or missing."""
    return ratio(now, before) - 1


def share(predicate: Column) -> Column:
    """Fraction of rows for which the predicate holds; rows where it is NULL count as false."""
    return F.avg(F.coalesce(predicate, F.lit(False)).cast("double"))


def count_where(predicate: Column) -> Column:
    return F.coalesce(F.count_if(predicate), F.lit(0))


def full_frame(aggregate: Column, counted, window: WindowSpec, size: int) -> Column:
    """A rolling aggregate that is NULL until the frame holds `size` non-null values."""
    return F.when(F.count(col(counted)).over(window) == size, aggregate.over(window))


def clamp(value, low: float, high: float) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))


# Abramowitz-Stegun 7.1.26 coefficients: fixed values.
ERF_P = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z) -> Column:
    """Standard normal distribution function through a fixed erf polynomial (error below 1.5e-7)."""
    z = col(z)
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for coefficient in reversed(ERF_COEFFICIENTS):
        poly = (poly + F.lit(coefficient)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def p_positive(mean, error) -> Column:
    """One-sided p-value that a mean exceeds zero; a missing mean or a zero or missing error decides by sign alone."""
    mean, error = col(mean), col(error)
    degenerate = F.when(mean.isNull() | (mean <= 0), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(mean.isNull() | error.isNull() | (error == 0), degenerate).otherwise(
        1 - normal_cdf(ratio(mean, F.when(error != 0, error))))


def interval95(mean, error) -> tuple[Column, Column]:
    mean, error = col(mean), col(error)
    return mean - 1.96 * error, mean + 1.96 * error


def any_of(predicates: Sequence[Column]) -> Column:
    result = F.lit(False)
    for predicate in predicates:
        result = result | F.coalesce(predicate, F.lit(False))
    return result


def failed_names(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the checks that are false or unknown, in the given order."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(passed, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name))
        for name, passed in checks]))
