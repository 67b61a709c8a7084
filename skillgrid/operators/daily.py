"""Daily extremes, step times, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.nulls import nan_to_null

# Variable and coordinate names that inputs use, in order of preference.
TEMPERATURE = ("TMP2m", "2m_temperature", "t2m", "2t", "temperature_2m")
LATITUDE = ("lat", "latitude", "grid_yt", "y")
LONGITUDE = ("lon", "longitude", "grid_xt", "x")
KELVIN = 273.15


def pick_column(df: DataFrame | list[str], names: tuple[str, ...], label: str) -> str:
    """The column for the first of `names` that df (or a list of names) has, as it is
    written or, failing that, in another case; of columns that differ in case only, the last."""
    columns = df.columns if isinstance(df, DataFrame) else df
    other_case = {c.lower(): c for c in columns}
    found = (name if name in columns else other_case.get(name.lower()) for name in names)
    column = next(filter(None, found), None)
    if column is None:
        raise KeyError(f"no column for {label}: {', '.join(columns)}")
    return column


def pick_coordinate(names: tuple[str, ...], *parts: DataFrame | list[str]) -> str | None:
    """The first of `names`, as written, in the union of the names of all parts (columns of
    tables, lists of dimensions); None if there is none."""
    have = {c for part in parts for c in (part.columns if isinstance(part, DataFrame) else part)}
    return next((name for name in names if name in have), None)


def celsius(x: Column) -> Column:
    """Kelvin to Celsius, whatever the values are."""
    return x - F.lit(KELVIN)


def daily_extreme(df: DataFrame, keys: list[str], time: str = "ts", value: str = "value", how: str = "max") -> DataFrame:
    """keys, date, value, n: the day's maximum or minimum, and how many values it has.
    Missing values do not count; a day without any has a NULL value."""
    x = nan_to_null(F.col(value).cast("double"))
    agg = F.max(x) if how == "max" else F.min(x)
    return df.groupBy(*keys, F.to_date(time).alias("date")).agg(agg.alias("value"), F.count(x).alias("n"))


def daily_range(df: DataFrame, keys: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """Both extremes in one pass."""
    x = nan_to_null(F.col(value).cast("double"))
    return df.groupBy(*keys, F.to_date(time).alias("date")).agg(F.max(x).alias("max_value"), F.min(x).alias("min_value"), F.count(x).alias("n"))


def positional_times(df: DataFrame, keys: list[str], order: list[str], init: str) -> DataFrame:
    """step (from 0, by `order` within keys) and valid_time = init + 6 + 6 step hours."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("step", F.row_number().over(w) - 1)
    return out.withColumn("valid_time", temporal.valid_time(F.col(init), position=F.col("step")))


def with_valid_time(df: DataFrame, init: Column, time: str = "time", out: str = "ts") -> DataFrame:
    """df with the valid time of its time axis, by what the axis is: times stay as they are,
    intervals follow `init`; numbers in units "... since ..." are times, in units of
    microseconds, hours or days (metadata of the column) they follow `init`; without such
    units their place along the axis counts, as init + 6 + 6 i hours. The place is the
    column <time>_idx, or else the rank among the distinct values, which are as few as the
    steps of a forecast."""
    kind, units = df.schema[time].dataType.typeName(), str(df.schema[time].metadata.get("units", ""))
    t = F.col(time)
    if kind in ("timestamp_ntz", "timestamp", "date"):
        return df.withColumn(out, temporal.valid_time(init, t, "datetime"))
    if "interval" in kind:
        return df.withColumn(out, temporal.valid_time(init, t, "timedelta"))
    if " since " in units:
        return df.withColumn(out, temporal.cf_time(t, units))
    unit = temporal.unit_of(units)
    if unit:
        return df.withColumn(out, temporal.valid_time(init, t, unit))
    if f"{time}_idx" in df.columns:
        return df.withColumn(out, temporal.valid_time(init, position=F.col(f"{time}_idx")))
    places = df.select(time).distinct().withColumn("_place", F.row_number().over(Window.orderBy(time)) - 1)
    return df.join(places, time).withColumn(out, temporal.valid_time(init, position=F.col("_place"))).drop("_place")


def running(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """df with first_value, that of the first row within keys, and seen, the rows so far."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"first_value": F.first(value).over(w), "seen": F.count("*").over(w)})


def last_step(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_step(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def to_celsius(df: DataFrame, value: str, probe: DataFrame | None = None) -> DataFrame:
    """Kelvin to Celsius if the mean of the probe rows (by default all) is over 100; the
    decision is one for the table. The probe is a single-row aggregate."""
    x = nan_to_null(F.col(value).cast("double"))
    mean = (df if probe is None else probe).agg(F.avg(x).alias("_mean"))
    out = df.crossJoin(F.broadcast(mean))
    return out.withColumn(value, F.when(F.col("_mean") > 100, celsius(x)).otherwise(x)).drop("_mean")


def on_date(df: DataFrame, date: str | DataFrame, column: str = "date") -> DataFrame:
    """The rows of one day. A date that is given is looked up at once, and its absence is an
    error, not an empty result; a table of one row with the date is joined."""
    if isinstance(date, DataFrame):
        day = date.select(F.col(date.columns[0]).cast("date").alias(column))
        return df.join(F.broadcast(day), column).select(df.columns)
    out = df.where(F.col(column) == F.lit(date).cast("date"))
    if not out.take(1):
        raise KeyError(f"no rows on {date}")
    return out
