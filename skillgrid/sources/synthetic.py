"""Analytic inputs for a check of the whole chain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def cells(spark: SparkSession, south: float = 35.0, north: float = 37.0, west: float = 250.0, east: float = 252.0) -> DataFrame:
    """y, x, lat, lon of an 8 x 8 grid; y and x run from 0 to 1."""
    last = SIDE - 1
    out = spark.range(SIDE * SIDE).select((F.floor(F.col("id") / SIDE) / last).alias("y"), ((F.col("id") % SIDE) / last).alias("x"))
    return out.withColumn("lat", south + (north - south) * F.col("y")).withColumn("lon", west + (east - west) * F.col("x"))


def on_box(grid: DataFrame) -> DataFrame:
    """y, x, lat, lon of any grid of lat and lon; y and x run from 0 to 1 over it."""
    ends = grid.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))])
    place = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}")), F.lit(0.0))
    return grid.select("lat", "lon").crossJoin(F.broadcast(ends)).select(place("lat").alias("y"), place("lon").alias("x"), "lat", "lon")


def forecast(spark: SparkSession, lead_days: int, members: int = 3, seed: int | None = None, noise: float = 0.8, grid: DataFrame | None = None) -> DataFrame:
    """sample, step, lat, lon, TMP2m in Kelvin: a rise from 294 to 299 K over the lead, a
    bow over latitude, a little more for longer leads, and noise of 0.8 K."""
    steps = 4 * lead_days
    rows = (cells(spark) if grid is None else grid).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    trend = 294 + 5 * F.col("step") / max(1, steps - 1)
    value = trend + 1.5 * F.sin(math.pi * F.col("y")) + noise * F.randn(lead_days if seed is None else seed) + 0.02 * lead_days
    return rows.select("sample", "step", "lat", "lon", value.cast("float").alias("TMP2m"))


def observation(spark: SparkSession, grid: DataFrame | None = None) -> DataFrame:
    return (cells(spark) if grid is None else grid).select("lat", "lon", (25 + 3 * F.col("y") + 1.5 * F.col("x")).alias("value"))


def climate(template: DataFrame, baseline: float = 22.0, threshold: float = 1.0, value: str = "value") -> DataFrame:
    """Constant climate where the template has a value."""
    here = F.col(value).isNotNull() & ~F.isnan(value)
    return template.select("lat", "lon", F.when(here, F.lit(baseline)).alias("baseline"), F.when(here, F.lit(threshold)).alias("threshold"))
