"""Tables ready to be drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import signed_longitude
from ..functions.nulls import exceeds, nan_to_null


def limits(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Shared colour limits of two fields: least, greatest and greatest absolute value."""
    x, y = (nan_to_null(F.col(c).cast("double")) for c in (a, b))
    most = F.greatest(F.max(F.abs(x)), F.max(F.abs(y))).alias("abs_high")
    return df.groupBy(*by).agg(F.least(F.min(x), F.min(y)).alias("low"), F.greatest(F.max(x), F.max(y)).alias("high"), most)


def skill_map(skill: DataFrame, metric: str, stipple: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """lat, lon (-180..180), value (negatives blank, for the map only), stipple."""
    x = nan_to_null(F.col(metric).cast("double"))
    return skill.select(lat, signed_longitude(F.col(lon)).alias(lon), F.when(x >= 0, x).alias("value"), F.col(stipple).alias("stipple"))


def mean_event(fields: DataFrame, anomaly: str = "predicted_tmax_anomaly_C_ensmean", limit: str = "hot_anomaly_threshold_C") -> DataFrame:
    """fields with the binary event of the ensemble mean."""
    return fields.withColumn("ensemble_mean_event", exceeds(F.col(anomaly), F.col(limit)).cast("double"))


# The panels of the figures of a case, with their colour limits where these are
# fixed; "shared" limits come from limits(), "mirrored" ones from their absolute value.
EVENT_PANELS = (
    ("predicted_hot_extreme_probability", "event probability", 0.0, 1.0),
    ("observed_hot_extreme", "observed event", 0.0, 1.0),
    ("ensemble_uncertainty", "ensemble deviation", 0.0, None),
    ("prediction_error_observed_minus_predicted", "observed minus predicted", -1.0, 1.0),
)
SUMMARY_PANELS = (
    ("observed_daily_tmax_C", "observed daily maximum", None, None),
    ("observed_hot_extreme", "observed event", 0.0, 1.0),
    ("ensemble_uncertainty", "ensemble deviation", 0.0, None),
    ("predicted_hot_extreme_probability", "event probability", 0.0, 1.0),
)
TEMPERATURE_PANELS = (
    ("observed_daily_tmax_C", "observed daily maximum", "shared"),
    ("predicted_daily_tmax_C_member0", "daily maximum of member 0", "shared"),
    ("observed_tmax_anomaly_C", "observed anomaly", "mirrored"),
    ("predicted_tmax_anomaly_C_member0", "anomaly of member 0", "mirrored"),
)


def _cells(fields: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """One row a cell: what panels show is equal over the members."""
    names = {p[0] for p in (*EVENT_PANELS, *SUMMARY_PANELS, *TEMPERATURE_PANELS)}
    return fields.groupBy(*keys).agg(*[F.min_by(c, sample).alias(c) for c in sorted(names)])


def panels(fields: DataFrame, keys: list[str], spec: tuple[tuple, ...] = EVENT_PANELS, sample: str = "sample") -> DataFrame:
    """keys, panel (its place), field, title, value, low and high: a figure of fixed limits
    as one long table. NULL limits are those of the values."""
    one = lambda i, f, t, a, b: F.struct(
        F.lit(i).alias("panel"), F.lit(f).alias("field"), F.lit(t).alias("title"), F.col(f).cast("double").alias("value"),
        F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high"),
    )
    return _cells(fields, keys, sample).select(*keys, F.inline(F.array(*[one(i, *p) for i, p in enumerate(spec)])))


def temperature_panels(fields: DataFrame, keys: list[str], by: list[str], sample: str = "sample") -> DataFrame:
    """The same for observed and predicted temperatures: both maxima share their limits
    within `by` (some of the keys), and so do both anomalies, about zero. Limits come from
    windows over the cells, which are one row each, so that these are computed once."""
    (a, _, _), (b, _, _), (c, _, _), (d, _, _) = TEMPERATURE_PANELS
    rows, number = _cells(fields, keys, sample), lambda f: nan_to_null(F.col(f).cast("double"))
    every = Window.partitionBy(*by)
    low = F.least(F.min(number(a)).over(every), F.min(number(b)).over(every))
    high = F.greatest(F.max(number(a)).over(every), F.max(number(b)).over(every))
    wide = F.greatest(F.max(F.abs(number(c))).over(every), F.max(F.abs(number(d))).over(every))
    rows = rows.withColumns({"_low": low, "_high": high, "_wide": wide})
    ends = {"shared": (F.col("_low"), F.col("_high")), "mirrored": (-F.col("_wide"), F.col("_wide"))}
    one = lambda i, f, t, kind: F.struct(
        F.lit(i).alias("panel"), F.lit(f).alias("field"), F.lit(t).alias("title"), F.col(f).cast("double").alias("value"),
        ends[kind][0].alias("low"), ends[kind][1].alias("high"),
    )
    return rows.select(*keys, F.array(*[one(i, *p) for i, p in enumerate(TEMPERATURE_PANELS)]).alias("_p")).select(*keys, F.inline("_p"))


def skill_maps(saved: DataFrame, metric: str) -> DataFrame:
    """extreme, lead, lat, lon, value, stipple from the saved skill tables alone. The Brier
    score of reference follows each table's own threshold."""
    share = F.col("threshold_pct") / 100
    marks = {"rho": exceeds(F.col("rho_p"), F.lit(0.05)), "tau": exceeds(F.col("tau_p"), F.lit(0.05)), "brier": exceeds(F.col("brier"), share * (1 - share))}
    x = nan_to_null(F.col(metric).cast("double"))
    return saved.select("extreme", "lead", "lat", signed_longitude(F.col("lon")).alias("lon"), F.when(x >= 0, x).alias("value"), marks[metric].alias("stipple"))


def member_maps(fields: DataFrame, picked: DataFrame, keys: list[str], sample: str = "sample", value: str = "predicted_hot_extreme") -> DataFrame:
    """Indicator maps of the picked members only."""
    return fields.join(picked, sample, "left_semi").select(*keys, sample, value)
