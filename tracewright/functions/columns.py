"""Column functions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Whether a number is there, not NaN and not infinite; never null."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def within_ppm(observed: Column, expected: Column, ppm: Column | float) -> Column:
    """Relative difference to the second argument; false unless both are finite and above 0."""
    fine = finite(observed) & finite(expected) & (observed > 0) & (expected > 0)
    return F.coalesce(fine & (F.abs(observed - expected) / F.abs(expected) * 1e6 <= ppm), F.lit(False))


def ppm_distance(left: Column, right: Column) -> Column:
    """Relative difference in parts per million of the first argument, which counts as 1e-12 at least."""
    return F.abs(left - right) / F.greatest(F.abs(left), F.lit(1e-12)) * 1e6


def first_of(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    chain = reduce(lambda w, r: w.when(r[0], value(r[1])), rules[1:], F.when(rules[0][0], value(rules[0][1])))
    return chain.otherwise(value(otherwise))


def flags(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def median(x: Column | str) -> Column:
    """The exact median, with the mean of the middle pair."""
    return F.percentile(x, 0.5)


def median_absolute_deviation(x: str, centre: str) -> Column:
    return F.percentile(F.abs(F.col(x) - F.col(centre)), 0.5)


def token_key(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
