"""The driver's star schema as gridded forecasts and observations.

A nation is a grid cell, a line number an ensemble member, a year a case. Forecast values
are extended prices of shipped lines, observed values total prices of orders; each has its
own climate, as their units differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, lat, lon of 25 cells."""
    key = F.col("n_nationkey")
    lat, lon = 20.0 + 10 * F.floor(key / 5), 200.0 + 20 * (key % 5)
    return load(spark, sf_dir, "nation").select(key.alias("cell"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, year, sample, value: the largest price of the member in that year."""
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), (F.col("l_linenumber") - 1).alias("sample"), "l_extendedprice")
    # summing up by supplier first shrinks what the join moves
    lines = lines.groupBy("l_suppkey", "year", "sample").agg(F.max("l_extendedprice").alias("value"))
    cells = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cell"))
    return lines.join(cells, "l_suppkey").groupBy("cell", "year", "sample").agg(F.max("value").alias("value"))


def observed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, date, value: the largest order of the day."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    cells = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell"))
    return orders.join(cells, "o_custkey").groupBy("cell", "date").agg(F.max("o_totalprice").alias("value"))


def observed_yearly(daily: DataFrame, *of_cell: str) -> DataFrame:
    """cell, year, value on the last day with an order in January to June, and columns
    that are equal for all days of a cell."""
    rows = daily.where(F.month("date") <= 6).groupBy("cell", F.year("date").alias("year"))
    return rows.agg(F.max_by("value", "date").alias("value"), *[F.first(c).alias(c) for c in of_cell])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, cell (user), ts, value."""
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("cell"), "ts", "value")
