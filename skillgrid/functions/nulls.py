"""Comparisons and statistics that treat NaN and NULL as "no value".

Array libraries say that a comparison with NaN is false; Spark and SQL order NaN above
all numbers. An exceedance of or by a missing value is therefore False here, never NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(float("nan")))


def _valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def exceeds(x: Column, limit: Column) -> Column:
    """x > limit, False where either is missing."""
    return F.coalesce(_valid(x) & _valid(limit) & (x > limit), F.lit(False))


def falls_below(x: Column, limit: Column) -> Column:
    return F.coalesce(_valid(x) & _valid(limit) & (x < limit), F.lit(False))


def finite(*xs: Column) -> Column:
    """Whether all are numbers, neither missing nor infinite."""
    out = F.lit(True)
    for x in xs:
        out = out & F.coalesce(_valid(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return out


def as_number(flag: Column) -> Column:
    return flag.cast("double")


def pearson(x: Column, y: Column) -> Column:
    """An aggregate: population correlation, NULL where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
