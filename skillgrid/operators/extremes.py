"""Event indicators of ensemble members, and what they add up to in each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import as_number, exceeds, falls_below, nan_to_null

#: Output order of extremes_fields().
FIELDS = (
    "predicted_hot_extreme", "observed_hot_extreme", "predicted_hot_extreme_probability", "prediction_error_observed_minus_predicted",
    "ensemble_uncertainty", "monthly_tmax_baseline_C", "hot_anomaly_threshold_C", "predicted_daily_tmax_C_ensmean",
    "predicted_tmax_anomaly_C_ensmean", "predicted_daily_tmax_C_member0", "predicted_tmax_anomaly_C_member0",
    "observed_daily_tmax_C", "observed_tmax_anomaly_C",
)


def event(x: Column, limit: Column, side: str = "hot") -> Column:
    """Strictly beyond the limit; a missing value is no event."""
    return exceeds(x, limit) if side == "hot" else falls_below(x, limit)


def event_probability(
    members: DataFrame, thresholds: DataFrame | None, cell: list[str], case: list[str], side: str = "hot", value: str = "value", also: tuple[Column, ...] = ()
) -> DataFrame:
    """cell and case keys, probability (the share of all members, missing ones included),
    spread (population deviation of the indicator), n_members and the aggregates `also`.
    `thresholds` has the cell keys and `threshold`; cells without one drop out, as labelled
    arrays align. Without it the members themselves have `threshold`."""
    x = nan_to_null(F.col(value).cast("double"))
    rows = members if thresholds is None else members.join(thresholds.select(*cell, "threshold"), cell)
    hit = as_number(event(x, F.col("threshold"), side))
    return rows.groupBy(*cell, *case).agg(F.avg(hit).alias("probability"), F.stddev_pop(hit).alias("spread"), F.count("*").alias("n_members"), *also)


def ensemble_mean_anomaly(
    members: DataFrame, baseline: DataFrame | None, cell: list[str], case: list[str], value: str = "value", also: tuple[Column, ...] = ()
) -> DataFrame:
    """cell and case keys, ensemble_mean, anomaly (about `baseline`, or the members' own
    column of that name) and the aggregates `also`."""
    x = nan_to_null(F.col(value).cast("double"))
    mean = members.groupBy(*cell, *case)
    if baseline is None:
        mean = mean.agg(F.avg(x).alias("ensemble_mean"), F.first("baseline").alias("_b"), *also)
    else:
        mean = mean.agg(F.avg(x).alias("ensemble_mean"), *also).join(baseline.select(*cell, F.col("baseline").alias("_b")), cell)
    return mean.withColumn("anomaly", F.col("ensemble_mean") - F.col("_b")).drop("_b")


def extremes_fields(
    members: DataFrame, observed: DataFrame, climate: DataFrame | None, observed_climate: DataFrame | None,
    cell: list[str], case: list[str], member: str = "sample", value: str = "value",
) -> DataFrame:
    """A row for each cell, case and member with the 13 fields; all but the member's own
    indicator are equal over the members. Climates have `baseline` and the `threshold` of
    the anomaly (one each, as forecast and observation may differ in units); without them
    the rows have these columns themselves."""
    x = nan_to_null(F.col(value).cast("double"))
    of = lambda df, climate: df if climate is None else df.join(climate.select(*cell, "baseline", "threshold"), cell)
    rows = of(members, climate)
    rows = rows.withColumn("anomaly", x - F.col("baseline")).withColumn("hit", as_number(event(F.col("anomaly"), F.col("threshold"))))
    first = lambda c: F.min_by(c, member)
    cells = rows.groupBy(*cell, *case).agg(
        F.avg("hit").alias("p"), F.stddev_pop("hit").alias("spread"), F.avg(x).alias("mean"), F.avg("anomaly").alias("mean_anomaly"),
        first(x).alias("m0"), first(F.col("anomaly")).alias("m0_anomaly"), F.first("baseline").alias("b"), F.first("threshold").alias("t"),
        F.collect_list(F.struct(member, "hit")).alias("members"),
    )
    y = nan_to_null(F.col(value).cast("double"))
    off = y - F.col("baseline")
    seen = of(observed, observed_climate).select(*cell, *case, y.alias("o"), off.alias("o_anomaly"), as_number(event(off, F.col("threshold"))).alias("o_hit"))
    out = cells.join(seen, [*cell, *case]).withColumn("m", F.explode("members"))
    columns = ("m.hit", "o_hit", "p", None, "spread", "b", "t", "mean", "mean_anomaly", "m0", "m0_anomaly", "o", "o_anomaly")
    named = [(F.col("o_hit") - F.col("p") if c is None else F.col(c)).alias(n) for n, c in zip(FIELDS, columns)]
    return out.select(*cell, *case, F.col(f"m.{member}").alias(member), *named)
