"""Daily extremes over a stream: an extension of the batch operator for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import nan_to_null


def daily_extremes(stream: DataFrame, keys: list[str], time: str = "ts", value: str = "value", late: str = "6 hours") -> DataFrame:
    """keys, date, max_value, min_value, n; a day is final once the watermark has passed it,
    and later rows of it are left out. `time` is a timestamp with or without a zone."""
    x = nan_to_null(F.col(value).cast("double"))
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    days = rows.groupBy(*keys, F.window("_t", "1 day")).agg(F.max(x).alias("max_value"), F.min(x).alias("min_value"), F.count(x).alias("n"))
    return days.select(*keys, F.to_date("window.start").alias("date"), "max_value", "min_value", "n")
