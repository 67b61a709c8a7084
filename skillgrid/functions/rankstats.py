"""P-values of rank correlations as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r of n pairs by Student's t with n - 2 degrees of
    freedom, as the finite trigonometric sum for whole degrees; NULL under one degree."""
    nu = (n - 2).cast("int")
    s, c2 = F.abs(r), F.greatest(F.lit(0.0), 1 - r * r)
    odd = nu % 2 == 1
    terms = F.floor(F.when(odd, (nu - 1) / 2).otherwise(nu / 2)).cast("int")
    begin = F.struct(F.when(odd, F.sqrt(c2)).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        ratio = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct((acc["term"] * c2 * ratio).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, begin, add, lambda acc: acc["sum"])
    p = F.when(odd, 1 - (F.asin(F.least(F.lit(1.0), s)) + s * total) * (2 / math.pi)).otherwise(1 - s * total)
    return F.when((nu >= 1) & r.isNotNull(), F.greatest(F.lit(0.0), p))


#: Where the series of the error function hands over to the continued fraction, and their terms.
ERF_SPLIT, SERIES_TERMS, FRACTION_TERMS = 3.0, 60, 60


def normal_p(z: Column) -> Column:
    """Two-sided normal p of z, erfc(|z| / sqrt 2): by the series of erf with positive terms
    for small arguments, by the continued fraction of erfc beyond. NULL and NaN give NULL."""
    x = F.abs(z) / math.sqrt(2)
    bell = F.exp(-x * x)
    begin = F.struct(x.alias("term"), F.lit(0.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        return F.struct((acc["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    erf = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), begin, add, lambda acc: acc["sum"]) * bell * (2 / math.sqrt(math.pi))
    below = F.aggregate(F.sequence(F.lit(FRACTION_TERMS), F.lit(1)), x, lambda acc, k: x + k / 2 / acc)
    p = F.when(x < ERF_SPLIT, F.greatest(F.lit(0.0), 1 - erf)).otherwise(bell / below / math.sqrt(math.pi))
    return F.when(z.isNotNull() & ~F.isnan(z), p)
