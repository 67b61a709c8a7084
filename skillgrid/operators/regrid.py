"""Nearest-neighbour regridding, each axis on its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sources(axes: dict[str, DataFrame], parts: int) -> DataFrame:
    """axis, x, s, part: the distinct values of all axes, in every part."""
    one = next(iter(axes.values()))
    if all(df is one for df in axes.values()):  # one pass over a table that has them all
        src = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("x")) for c in axes])).alias("v")).select("v.*")
    else:
        src = reduce(DataFrame.unionByName, [df.select(F.lit(c).alias("axis"), F.col(c).cast("double").alias("x")) for c, df in axes.items()])
    src = src.where("x is not null and not isnan(x)").distinct()
    return src.select("axis", "x", F.col("x").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))


def nearest_of(axes: dict[str, DataFrame], targets: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of `targets` with the columns source_<axis>, for each axis the nearest value
    to the column of its name, of two equally near ones the larger; NULL for NULL, NaN, or an
    axis without values.

    Running windows over the sorted union of both lists give the source values on both sides
    of a target. Targets are dealt by hash to `parts` parts (by default the shuffle
    partitions), and each has the whole axis, so that neither many targets nor an uneven
    spread of them makes one task long, and nothing has to be known of either beforehand."""
    parts = parts or int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(c) for c in targets.columns])
    places = [F.struct(F.lit(c).alias("axis"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("x")) for c in axes]
    dst = targets.select(row.alias("row"), F.explode(F.array(*places)).alias("v")).select("row", "v.*")
    dst = dst.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    by = Window.partitionBy("axis", "part")
    both = dst.unionByName(_sources(axes, parts), allowMissingColumns=True)
    found = both.withColumn("left", F.max("s").over(by.orderBy("x"))).withColumn("right", F.min("s").over(by.orderBy(F.desc("x")))).where("s is null")
    near = F.when(F.col("left").isNull() | (F.col("right") - F.col("x") <= F.col("x") - F.col("left")), F.col("right")).otherwise(F.col("left"))
    found = found.select("row", "axis", F.when(F.col("x").isNotNull(), near).alias("source"))
    each = found.groupBy("row").agg(*[F.max(F.when(F.col("axis") == c, F.col("source"))).alias(f"source_{c}") for c in axes])
    return each.select("row.*", *[f"source_{c}" for c in axes])


def nearest(axis: DataFrame, template: DataFrame, name: str) -> DataFrame:
    """For each distinct `name` of the template the nearest one of the axis as source_<name>."""
    return nearest_of({name: axis}, template.select(name)).where(F.col(f"source_{name}").isNotNull())


def to_template(df: DataFrame, template: DataFrame, lat: str = "lat", lon: str = "lon", axes: dict[str, DataFrame] | None = None) -> DataFrame:
    """df's values on the template's cells; other columns of df follow. `axes` has the
    values of both axes where they are known, else they are those of df."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    cells = nearest_of({lat: axes[lat], lon: axes[lon]} if axes else {lat: df, lon: df}, template.select(lat, lon))
    source = df.withColumnsRenamed({lat: "_lat", lon: "_lon"})
    on = (F.col("_lat").cast("double") == F.col(f"source_{lat}")) & (F.col("_lon").cast("double") == F.col(f"source_{lon}"))
    return source.join(cells, on).select(lat, lon, *rest)
