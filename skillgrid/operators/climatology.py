"""Means and percentile thresholds of each cell. Percentiles are exact."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import temporal
from ..functions.nulls import nan_to_null


def mean_of(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(nan_to_null(F.col(value).cast("double"))).alias("baseline"))


def threshold(df: DataFrame, keys: list[str], q: float, value: str = "value") -> DataFrame:
    """keys, threshold: the q-quantile, linear between order statistics, and n_samples."""
    x = nan_to_null(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.percentile(x, q).alias("threshold"), F.count(x).alias("n_samples"))


THRESHOLD = StructType([StructField("threshold", DoubleType()), StructField("n_samples", LongType())])
#: Ranges of a round of exact_quantile, and values of a key that one task may sort.
RANGES, FEW = 64, 20_000


def exact_quantile(df: DataFrame, keys: list[str], q: float, value: str = "value", few: int = FEW) -> DataFrame:
    """What threshold() gives, for keys of any number of values (no keys: one row): no task
    holds more than `few` values of a key. NULL where a key has no values.

    Each round cuts the values that are left at approximate quantiles into RANGES ranges,
    counts them (sums before the shuffle), and keeps the range that has the wanted place, until
    few or equal values are left, which are sorted. A thousand million values take four rounds
    over the input; what goes from round to round is one row for each key, joined to the
    values."""
    spark = df.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]
    x = nan_to_null(F.col(value).cast("double")).alias("x")
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], x)
    place = (F.col("n") - 1) * F.lit(q)
    state = rows.groupBy(*names).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = state.withColumns({"at": F.floor(place), "before": F.lit(0).cast("long"), "left": F.col("n")})
    kinds = state.schema
    held = state.collect()  # a row for each key, from here on
    if not held:
        return spark.createDataFrame([], StructType([*df.select(*keys).schema.fields, *THRESHOLD.fields]))

    def with_state() -> DataFrame:
        told = spark.createDataFrame(held, kinds).where("n > 0").withColumnsRenamed({n: f"_{n}" for n in names})
        told = F.broadcast(told) if len(held) <= 10_000 else told
        same = reduce(and_, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names), F.lit(True))
        return rows.join(told, same & F.col("x").between(F.col("lo"), F.col("hi"))).drop(*[f"_{n}" for n in names])

    while max((r["left"] for r in held if r["n"] and r["lo"] < r["hi"]), default=0) > few:
        inside = with_state()
        cuts = inside.groupBy(*names).agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 20 * RANGES).alias("cuts"))
        cuts = cuts.withColumnsRenamed({n: f"_{n}" for n in names})
        same = reduce(and_, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names), F.lit(True))
        cut = inside.join(F.broadcast(cuts) if len(held) <= 10_000 else cuts, same)
        cut = cut.withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("x"))))
        counts = cut.groupBy(*names, "part", "n", "at", "before").agg(F.count("*").alias("left"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        w = Window.partitionBy(*names).orderBy("part")
        counts = counts.withColumn("before", F.col("before") + F.sum("left").over(w) - F.col("left"))
        found = counts.where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("left")))
        held = [*found.select(*kinds.names).collect(), *(r for r in held if not r["n"])]
    lowest = with_state().groupBy(*names, "n", "at", "before").agg(F.sort_array(F.collect_list(F.when(F.col("lo") < F.col("hi"), F.col("x")))).alias("xs"), F.first("lo").alias("lo"))
    low = F.coalesce(F.get("xs", (F.col("at") - F.col("before")).cast("int")), F.col("lo"))
    lowest = lowest.select(*[F.col(n).alias(f"_{n}") for n in names], "n", "at", low.alias("low"))
    same = reduce(and_, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names), F.lit(True))
    # the value after it: the same one if there are more of it, else the least above
    both = rows.where("x is not null").join(F.broadcast(lowest) if len(held) <= 10_000 else lowest, same).groupBy(*names, "n", "at", "low")
    both = both.agg(F.count_if(F.col("x") <= F.col("low")).alias("upto"), F.min(F.when(F.col("x") > F.col("low"), F.col("x"))).alias("next"))
    high = F.when((F.col("upto") > F.col("at") + 1) | F.col("next").isNull(), F.col("low")).otherwise(F.col("next"))
    out = both.select(*names, (F.col("low") + (high - F.col("low")) * (place - F.col("at"))).alias("threshold"), F.col("n").alias("n_samples"))
    none = spark.createDataFrame([r for r in held if not r["n"]], kinds).select(*names, F.lit(None).cast("double").alias("threshold"), F.col("n").alias("n_samples"))
    return out.unionByName(none).withColumnsRenamed(dict(zip(names, keys)))


def with_climate(df: DataFrame, keys: list[str], hot: float, cold: float, value: str = "value") -> DataFrame:
    """df with baseline, hot and cold of its own keys (mean and two quantiles of all rows of
    the key), without a second pass over its sources. A key's rows meet in one task, as they
    do for an exact quantile anyway: those of a grid cell, days times years."""
    x, w = nan_to_null(F.col(value).cast("double")), Window.partitionBy(*keys)
    made = {"baseline": F.avg(x), "hot": F.percentile(x, hot), "cold": F.percentile(x, cold)}
    return df.withColumns({name: agg.over(w) for name, agg in made.items()})


def anomaly_threshold(df: DataFrame, keys: list[str], q: float, value: str = "value") -> DataFrame:
    """keys, baseline, threshold of the anomaly about it, n_samples. A quantile commutes
    with a shift, so one pass over the values gives both."""
    x = nan_to_null(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.avg(x).alias("baseline"), (F.percentile(x, q) - F.avg(x)).alias("threshold"), F.count(x).alias("n_samples"))


def window_days(targets: DataFrame, half_days: int, first_year: Column, last_year: Column) -> DataFrame:
    """target and date: for each target date the days within half_days of it in each year
    of the baseline (29 February is 28 February in other years). Exploding the calendar
    makes the range join an equality join on a few hundred rows."""
    years = targets.withColumn("year", F.explode(F.sequence(first_year, last_year)))
    centre = temporal.same_day(F.col("year"), F.month("target"), F.dayofmonth("target"))
    days = years.select("target", F.explode(F.sequence(F.date_sub(centre, half_days), F.date_add(centre, half_days))).alias("date"))
    return days


def window_climatology(daily: DataFrame, targets: DataFrame, keys: list[str], half_days: int, first_year: Column, last_year: Column, q: float, value: str = "value") -> DataFrame:
    """target, keys, baseline, threshold (of the anomaly) and n_samples. The days grow with
    targets, years and window; the optimizer broadcasts them while they are small."""
    days = window_days(targets, half_days, first_year, last_year)
    return anomaly_threshold(daily.join(days, "date"), ["target", *keys], q, value)


def window_months(targets: DataFrame, half_days: int, first_year: Column, last_year: Column) -> DataFrame:
    """target, year, month: the months that a window touches, to prune what is read."""
    days = window_days(targets, half_days, first_year, last_year)
    return days.select("target", F.year("date").alias("year"), F.month("date").alias("month")).distinct()
