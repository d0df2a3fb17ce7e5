"""Arithmetic of the scores: rounding half up, guarded division, clamps, cohort scales and medians."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """floor(x + 0.5) at the given place, also for negative halves."""
    if places:
        return F.floor(x * 10**places + 0.5) / 10**places
    return F.floor(x + 0.5)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b as a double; ``otherwise``, or null, where b is zero or null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def scaled(x: Column, low: Column, high: Column, log: bool = False, invert: bool = False) -> Column:
    """x between the cohort's least and greatest value as 0 to 100.

    The logarithmic branch holds for x > 0 and greatest > 0; a cohort of one value gives 50, or null in that branch.
    """
    linear = F.when(high == low, F.lit(50.0)).otherwise(ratio(x - low, high - low) * 100)
    out = linear
    if log:
        lg = lambda c: F.log10(F.greatest(c, F.lit(0)) + 1)
        out = F.when((x > 0) & (high > 0), ratio(lg(x) - lg(low), lg(high) - lg(low)) * 100).otherwise(linear)
    if invert:
        out = 100 - out
    return F.when(out.isNotNull(), clamp(out, 0.0, 100.0))


def upper_median(x: Column) -> Column:
    """Of n sorted values the one at floor(n / 2), counted from 0. For groups of bounded size."""
    values = F.array_sort(F.collect_list(x))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def hours(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9


def r4(x: Column) -> Column:
    return F.round(x.cast("double"), 4)
