"""Distributions as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(d: Column) -> Column:
    return F.aggregate(d, F.lit(0.0), lambda a, x: a + x)


def normalize(d: Column) -> Column:
    """Shares of the sum; empty distributions and such without mass stay as they are."""
    return F.when(total(d) == 0.0, d).otherwise(F.transform(d, lambda x: x / total(d)))


def to_log(d: Column) -> Column:
    """Logarithms; of zero it is minus infinity."""
    return F.transform(d, lambda x: F.when(x == 0.0, F.lit(float("-inf"))).otherwise(F.ln(x)))


def from_log(d: Column) -> Column:
    """Normalised probabilities of logarithms, which are offset by the largest so that none underflows."""
    return normalize(F.transform(d, lambda x: F.exp(x - F.array_max(d))))


def add_logs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def logarithmic_bins(start: int, end: int, factor: float) -> list[int]:
    """Bins from ``start`` up to ``end``, each ``factor`` times the one before, rounded half away from zero."""
    bins, at = [], float(start)
    while at <= end:
        bins.append(int(at + 0.5))
        at *= factor
    return bins
