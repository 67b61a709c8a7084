"""Boundary fields: positions, replication over members, fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_positions(df: DataFrame, positions: list[int], index: str = "time_idx") -> DataFrame:
    """The rows at the listed positions of a stored index; the list reaches the scan."""
    return df.where(F.col(index).isin(*sorted(set(positions))))


def template(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The distinct cells of a table."""
    return df.select(lat, lon).distinct()


def replicate(df: DataFrame, members: int, sample: str = "sample") -> DataFrame:
    """A copy of each row for each member, unless the table has members already."""
    if sample in df.columns:
        return df
    return df.withColumn(sample, F.explode(F.sequence(F.lit(0), F.lit(members - 1))))


def collapse_time(df: DataFrame, keys: list[str], value: str = "value", index: str = "time_idx") -> DataFrame:
    """A field that should not vary in time, as it is at its first time."""
    return df.groupBy(*keys).agg(F.min_by(value, index).alias(value))


def substitute(df: DataFrame, constants: dict[str, float], name: str = "name", value: str = "value") -> DataFrame:
    """Values of the named variables replaced by constants; others stay."""
    if not constants:
        return df
    table = F.create_map(*[F.lit(x) for item in constants.items() for x in item])
    return df.withColumn(value, F.coalesce(F.try_element_at(table, F.col(name)), F.col(value).cast("double")))


def describe(df: DataFrame, column: str, **attributes: str) -> DataFrame:
    """df with attributes (units, long_name) on a column, which Parquet keeps."""
    held = dict(df.schema[column].metadata)
    return df.withMetadata(column, held | {k: v for k, v in attributes.items() if k not in held})
