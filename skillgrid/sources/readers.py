"""Readers of gridded tables, plans and configurations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.geo import in_box
from ..operators.daily import LATITUDE, LONGITUDE, TEMPERATURE, pick_column
from . import arrays

#: Names of time axes.
TIMES = ("ts", "time", "valid_time")
PLAN_SCHEMA = "target_date string, lead_days int, init_time string, required_horizon_days int, required_6hour_steps int, prediction_path string, prediction_exists boolean"


def read_grid(
    spark: SparkSession, path: str | list[str], value: str = "value", format: str = "parquet", box: tuple[float, float, float, float] | None = None,
    times: list[tuple[str, str]] | None = None, **options: str,
) -> DataFrame:
    """A long table with the columns lat, lon and `value` under one name, whatever the
    input calls them; other columns follow. Of array files (netcdf, zarr; `options` are
    those of arrays, and groups: JSON of ranges of the path's groups) only that variable is read, with the place along the time axis as
    time_idx, and of it the chunks and bytes that a box (south, north, west, east) and
    ranges of times (ends included) touch. Any other format is a lazy scan, filters on the
    table's columns reach the files."""
    if format not in ("netcdf", "zarr"):
        df = spark.read.format(format).options(**options).load(path)
        names = _names(df.columns, value)
        df = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
        if box:
            df = df.where(in_box(F.col("lat"), F.col("lon"), box, df.agg(F.max("lon")).first()[0]))
        time = next((c for c in TIMES if c in df.columns), None)
        if times and time:
            df = df.where(reduce(or_, [F.col(time).between(*(F.lit(x).cast("timestamp_ntz") for x in one)) for one in times]))
        return df
    source = arrays.header(path if isinstance(path, str) else path[0], format)
    names = _names([n for n, v in source.variables.items()] + [d for v in source.variables.values() for d in v.dims], value)
    variable, lat, lon = names
    dims, ranges = source.variables[variable].dims, {}
    time = next((d for d in TIMES if d in dims), None)
    if box:
        turn = 360 * int(box[2] > 180 >= float(np.max(source.slab(lon)))) if lon in source.variables else 0
        ranges = {lat: [box[:2]], lon: [(box[2] - turn, box[3] - turn)]}
    if times and time:
        ranges[time] = times
    ranges |= json.loads(options.pop("groups", "{}"))
    with_index = {"with_index": time} if time else {}
    df = arrays.load(spark, format, path, ranges, **{"variables": variable, "decode_times": "true"} | with_index | options)
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def axes(spark: SparkSession, path: str, format: str, box: tuple[float, float, float, float] | None = None) -> dict[str, DataFrame] | None:
    """lat and lon of an array file from its header, within a box; None for other formats."""
    if format not in ("netcdf", "zarr"):
        return None
    source, out = arrays.header(path, format), {}
    names = list(source.variables)
    for axis, aliases, (low, high) in (("lat", LATITUDE, box[:2] if box else (None, None)), ("lon", LONGITUDE, box[2:] if box else (None, None))):
        name = pick_column(names, aliases, axis)
        values = source.variables[name].unpacked(source.slab(name)).to_numpy(zero_copy_only=False).astype(float)
        if axis == "lon" and box and low > 180 >= values.max():
            low, high = low - 360, high - 360
        kept = values if low is None else values[(values >= low) & (values <= high)]
        out[axis] = spark.createDataFrame([(float(x),) for x in kept], f"{axis} double")
    return out


def _names(columns: list[str], value: str) -> dict[str, str]:
    """What the columns of the value, latitude and longitude are called from now on."""
    return {pick_column(columns, TEMPERATURE, "temperature"): value, pick_column(columns, LATITUDE, "latitude"): "lat", pick_column(columns, LONGITUDE, "longitude"): "lon"}


def read_skill(spark: SparkSession, path: str) -> DataFrame:
    """Saved skill tables. The names of extremes and leads are text: left to itself, Spark
    takes a folder lead=030d for the number 30."""
    fields = spark.read.parquet(path).schema.fields
    named = [StructField(f.name, StringType()) if f.name in ("extreme", "lead") else f for f in fields]
    return spark.read.schema(StructType(named)).parquet(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PLAN_SCHEMA)


def time_slice(df: DataFrame, start: str, end: str, time: str = "ts") -> DataFrame:
    """Both ends included; a range of the raw column, so that it is pushed to the scan."""
    return df.where(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def positions(df: DataFrame, first: int, last: int, index: str = "time_idx") -> DataFrame:
    """Rows first..last-1 of a stored time index."""
    return df.where(F.col(index).between(first, last - 1))


def format_of(path: str) -> str:
    """By the end of the name: NetCDF, Zarr, or else Parquet."""
    name = path.rstrip("/").lower()
    return "netcdf" if name.endswith((".nc", ".cdf", ".nc3")) else "zarr" if name.endswith(".zarr") else "parquet"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fingerprint(spark: SparkSession, path: str) -> str:
    """How many files and bytes a path has, and when it last changed; of a Zarr store its
    consolidated metadata alone, as listing a large store takes long."""
    meta = f"{path.rstrip('/')}/.zmetadata"
    path = meta if exists(spark, meta) else path
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    told = fs.getContentSummary(at)
    return f"{path}:{told.getFileCount()}:{told.getLength()}:{fs.getFileStatus(at).getModificationTime()}"


def require(spark: SparkSession, paths: list[str]) -> None:
    """Fails with a list of all inputs that are absent."""
    absent = [p for p in paths if not exists(spark, p)]
    if absent:
        raise FileNotFoundError("missing inputs:\n" + "\n".join(absent))


@dataclass(frozen=True)
class Config:
    """Settings of a hindcast. `bbox` is south, north, west, east."""

    output_root: str
    target_dates: list[str]
    lead_days: list[int]
    bbox: tuple[float, float, float, float]
    expected_members: int
    baseline_start_year: int
    analysis: str
    prediction_pattern: str
    baseline_end_year: int | None = None
    figure_formats: list[str] = field(default_factory=lambda: ["png"])
    max_map_members: int = 6
    skill: dict[str, Any] = field(default_factory=dict)
    model: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, raw: dict[str, Any], base: Path) -> Config:
        """Relative paths start at `base`; the analysis store is taken as it is. Its setting
        is `analysis`, or any that ends in _zarr."""
        own = lambda p: str(p) if "://" in str(p) or Path(p).is_absolute() else str(base / p)
        store = raw.get("analysis") or next((v for k, v in raw.items() if k.endswith("_zarr")), None)
        needed = ("output_root", "target_dates", "lead_days", "bbox", "expected_members", "baseline_start_year", "prediction_pattern")
        if absent := [k for k in needed if k not in raw] + ["analysis"] * (store is None):
            raise KeyError(f"missing settings: {', '.join(absent)}")
        return cls(
            own(raw["output_root"]), [str(x) for x in raw["target_dates"]], [int(x) for x in raw["lead_days"]], tuple(float(x) for x in raw["bbox"]),
            int(raw["expected_members"]), int(raw["baseline_start_year"]), str(store), own(raw["prediction_pattern"]),
            raw.get("baseline_end_year") and int(raw["baseline_end_year"]), list(raw.get("figure_formats", ["png"])), int(raw.get("max_map_members", 6)),
            dict(raw.get("skill", {})), dict(raw.get("model", {})),
        )

    @classmethod
    def read(cls, path: str | Path) -> Config:
        """From YAML where a YAML library is installed, and from JSON."""
        at = Path(path).resolve()
        text = at.read_text()
        try:
            import yaml
        except ModuleNotFoundError:
            return cls.from_mapping(json.loads(text), at.parent.parent)
        return cls.from_mapping(yaml.safe_load(text), at.parent.parent)

    def last_baseline_year(self, target_year: int) -> int:
        return self.baseline_end_year or target_year - 1
