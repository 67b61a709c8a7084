"""Queries of the verification engine on the driver's tables, and their SQL in DuckDB.

Both sides cast and round alike (6 places), so that values can be compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.geo import in_box, signed_longitude
from ..functions.nulls import as_number
from ..operators import climatology, daily, extremes, forcing, lag, planning, plots, regrid, verification
from ..sources import readers, sinks, synthetic
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CELL, CASE = ["cell"], ["year"]
Q90, Q10 = 0.9, 0.1

# --- views of the tables in SQL ----------------------------------------------------------
VIEWS = {
    "grid": "SELECT n_nationkey AS cell, 20.0::DOUBLE + 10 * (n_nationkey // 5) AS lat, 200.0::DOUBLE + 20 * (n_nationkey % 5) AS lon FROM nation",
    "fc": "SELECT s_nationkey AS cell, year(l_shipdate)::INT AS year, l_linenumber - 1 AS sample, max(l_extendedprice) AS value "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "obd": "SELECT c_nationkey AS cell, o_orderdate::DATE AS date, max(o_totalprice) AS value FROM orders JOIN customer ON "
    "o_custkey = c_custkey GROUP BY ALL",
    "ob": "SELECT cell, year(date)::INT AS year, max_by(value, date) AS value FROM obd WHERE month(date) <= 6 GROUP BY ALL",
    "ts": "SELECT event_id, user_id AS cell, ts, value FROM events",
    "fct": "SELECT cell, avg(value) AS baseline, quantile_cont(value, 0.9) AS hot, quantile_cont(value, 0.1) AS cold FROM fc GROUP BY cell",
    "obt": "SELECT cell, avg(value) AS baseline, quantile_cont(value, 0.9) AS hot, quantile_cont(value, 0.1) AS cold FROM obd GROUP BY cell",
    "prob": "SELECT cell, year, avg(CASE WHEN value > hot THEN 1.0::DOUBLE ELSE 0 END) AS probability, stddev_pop(CASE WHEN value "
    "> hot THEN 1.0::DOUBLE ELSE 0 END) AS spread, count(*) AS n_members, avg(value) AS ens_mean, avg(value) - any_value(baseline) "
    "AS ens_anomaly, any_value(baseline) AS baseline, any_value(hot) AS hot FROM fc JOIN fct USING (cell) GROUP BY cell, year",
    "oev": "SELECT cell, year, value, value - baseline AS anomaly, baseline, hot, CASE WHEN value > hot THEN 1.0::DOUBLE ELSE 0 "
    "END AS observed FROM ob JOIN obt USING (cell)",
    "po": "SELECT prob.cell, prob.year, probability, observed, spread, ens_anomaly, ens_mean, oev.anomaly AS obs_anomaly, "
    "oev.value AS obs_value FROM prob JOIN oev ON prob.cell = oev.cell AND prob.year = oev.year",
    "rk": "SELECT cell, probability AS p, observed AS o, rank() OVER (PARTITION BY cell ORDER BY probability) + (count(*) OVER "
    "(PARTITION BY cell, probability) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY cell ORDER BY observed) + (count(*) OVER "
    "(PARTITION BY cell, observed) - 1) / 2.0 AS ro, count(*) OVER (PARTITION BY cell, probability) AS tp, count(*) OVER "
    "(PARTITION BY cell, observed) AS tob, row_number() OVER (PARTITION BY cell ORDER BY year) AS i FROM po",
    "sp": "SELECT cell, count(*) AS n, avg((p - o) * (p - o)) AS brier, CASE WHEN stddev_pop(o) > 0 THEN covar_pop(rp, ro) / "
    "nullif(stddev_pop(rp) * stddev_pop(ro), 0) END AS rho0, stddev_pop(o) AS std, sum(tp - 1) / 2.0 AS ptie, sum(tob - 1) / 2.0 "
    "AS otie, sum((tp - 1) * (tp - 2))::DOUBLE AS p0, sum((tob - 1) * (tob - 2))::DOUBLE AS o0, sum((tp - 1) * (2 * tp + "
    "5))::DOUBLE AS p1, sum((tob - 1) * (2 * tob + 5))::DOUBLE AS o1 FROM rk GROUP BY cell",
    "cc": "SELECT a.cell, sum(sign(a.p - b.p) * sign(a.o - b.o))::DOUBLE AS s FROM rk a JOIN rk b ON a.cell = b.cell AND a.i < b.i GROUP BY a.cell",
    "sk": """SELECT sp.cell, n, brier, CASE WHEN rho0 IS NOT NULL THEN greatest(-1, least(1, rho0)) END AS rho,
        CASE WHEN std > 0 THEN s / nullif(sqrt((n * (n - 1) / 2.0 - ptie) * (n * (n - 1) / 2.0 - otie)), 0) END AS tau, s,
        (n * (n - 1) * (2 * n + 5) - p1 - o1) / 18.0 + 2 * ptie * otie / nullif(n * (n - 1), 0)::DOUBLE + coalesce(p0 * o0 /
        nullif(9.0 * n * (n - 1) * (n - 2), 0), 0) AS var
        FROM sp LEFT JOIN cc ON sp.cell = cc.cell""",
}
VIEWS["skz"] = "SELECT *, CASE WHEN tau IS NOT NULL THEN s / nullif(sqrt(var), 0) END AS z, abs(CASE WHEN tau IS NOT NULL THEN s / nullif(sqrt(var), 0) END) / sqrt(2) AS x FROM sk"
_NEEDS = {"skz": ["sk"], "ob": ["obd"], "fct": ["fc"], "obt": ["obd"], "prob": ["fct"], "oev": ["ob", "obt"], "po": ["prob", "oev"], "rk": ["po"], "sp": ["rk"], "cc": ["rk"], "sk": ["sp", "cc"]}
#: Two-sided normal p of z: series of erf under 3, continued fraction of erfc beyond.
Z_P = """CASE WHEN x < 3 THEN greatest(0, 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 60), lambda n: x *
    coalesce(list_product(list_transform(range(1, n + 1), lambda k: 2 * x * x / (2 * k + 1))), 1))))
    WHEN x IS NOT NULL THEN exp(-x * x) / sqrt(pi()) / list_reduce(list_prepend(x, list_transform(range(60, 0, -1), lambda k:
        k::DOUBLE)), lambda f, k: x + k / 2 / f) END"""
#: Two-sided p of a correlation rho of n pairs, as the finite sum for whole degrees.
RHO_P = """CASE WHEN n >= 3 AND rho IS NOT NULL THEN greatest(0, CASE
    WHEN (n - 2) % 2 = 1 THEN 1 - (2 / pi()) * (asin(least(1, abs(rho))) + abs(rho) * coalesce(list_sum(list_transform(range(1, 1 + (n - 3) // 2),
        lambda k: pow(sqrt(greatest(0, 1 - rho * rho)), 2 * k - 1) * coalesce(list_product(list_transform(range(1, k), lambda j:
        2.0 * j / (2 * j + 1))), 1))), 0))
    ELSE 1 - abs(rho) * coalesce(list_sum(list_transform(range(1, 1 + (n - 2) // 2),
        lambda k: pow(greatest(0, 1 - rho * rho), k - 1) * coalesce(list_product(list_transform(range(1, k), lambda j: (2.0 * j -
            1) / (2 * j))), 1))), 0) END) END"""


def sql(body: str, *views: str) -> str:
    """`body` after the views it names, each after those it needs."""
    order: list[str] = []

    def add(v: str) -> None:
        for need in _NEEDS.get(v, []):
            add(need)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)
    return (f"WITH {head}\n" if head else "") + body


def query(name: str, oracle: str | None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def r6(x: Column | str) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double"), 6)


def day(x: Column | str) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def clock(x: Column | str) -> Column:
    """Date and time as strftime writes them: Spark's yyyy puts a sign before years over 9999 and pads negative ones."""
    return F.when(F.year(x).between(0, 9999), F.date_format(x, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(x, "y-MM-dd HH:mm:ss"))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- shared plans --------------------------------------------------------------------------


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """cell, year, sample, value with the climate of the cell, in one pass over the lines."""
    return climatology.with_climate(T.forecast(spark, sf), CELL, Q90, Q10)


def probabilities(spark: SparkSession, sf: str, side: str = "hot") -> DataFrame:
    """Event probabilities with the anomaly of the ensemble mean as fc_anomaly."""
    rows = forecasts(spark, sf).withColumn("threshold", F.col(side))
    mean = (F.avg("value") - F.first("baseline")).alias("fc_anomaly")
    return extremes.event_probability(rows, None, CELL, CASE, side, also=(mean,))


def observed_events(spark: SparkSession, sf: str) -> DataFrame:
    """cell, year, value, ob_anomaly, observed, in one pass over the orders."""
    rows = T.observed_yearly(climatology.with_climate(T.observed_daily(spark, sf), CELL, Q90, Q10), "baseline", "hot")
    hit = as_number(extremes.event(F.col("value"), F.col("hot"))).alias("observed")
    return rows.select("cell", "year", "value", (F.col("value") - F.col("baseline")).alias("ob_anomaly"), hit)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """cell, year, probability, observed, and the anomalies of ensemble mean and observation."""
    return probabilities(spark, sf).join(observed_events(spark, sf), ["cell", "year"])


def skill(spark: SparkSession, sf: str) -> DataFrame:
    return verification.rank_skill(pairs(spark, sf), CELL)


# --- planning and time ---------------------------------------------------------------------


@query(
    "plan_cases",
    """WITH t AS (SELECT make_date(1995 + r_regionkey, 4, 1) AS target, r_regionkey AS t FROM region), l AS (SELECT unnest([31, 59, 90]) AS lead)
    SELECT strftime(target, '%Y-%m-%d') AS target_date, lead::BIGINT AS lead_days, strftime(target - lead * INTERVAL 1 DAY,
    '%Y-%m-%dT%H:%M:%S') AS init_time,
    lead::BIGINT AS required_horizon_days, (lead * 4)::BIGINT AS required_6hour_steps,
    'pred_' || strftime(target, '%Y%m%d') || '_' || strftime(target - lead * INTERVAL 1 DAY, '%Y%m%d') || '_' ||
        lpad(lead::VARCHAR, 3, '0') AS prediction_path, lead = 31 AS prediction_exists FROM t, l""",
)
def plan_cases(spark: SparkSession, sf: str) -> DataFrame:
    targets = T.load(spark, sf, "region").select(F.make_date(F.col("r_regionkey") + 1995, F.lit(4), F.lit(1)).alias("target"))
    pattern = "pred_{target_yyyymmdd}_{init_yyyymmdd}_{lead:03d}"
    have = planning.build_cases(spark, targets, [31], pattern).select(F.col("prediction_path").alias("path"))
    return _long(planning.build_cases(spark, targets, [31, 59, 90], pattern, have), "lead_days", "required_horizon_days", "required_6hour_steps")


@query(
    "lag_init_times",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders), m AS (SELECT year, s, make_date(year, 11, 1)::TIMESTAMP
        + (6 * (s - 12)) * INTERVAL 1 HOUR AS t FROM y, range(25) AS r(s))
    SELECT year::BIGINT AS year, s::BIGINT AS sample, strftime(t, '%Y-%m-%d %H:%M:%S') AS init_time, date_diff('hour', TIMESTAMP
    '1940-01-01 12:00:00', t)::BIGINT AS hours_since_epoch,
    greatest(0, date_diff('hour', TIMESTAMP '1940-01-01 12:00:00', t) // 6)::BIGINT AS epoch_index FROM m""",
)
def lag_init_times(spark: SparkSession, sf: str) -> DataFrame:
    out = planning.lag_members(T.load(spark, sf, "orders").select(F.year("o_orderdate").alias("year")))
    return _long(out.withColumn("init_time", clock("init_time")), "year", "sample", "hours_since_epoch", "epoch_index")


@query(
    "target_dates",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders), l AS (SELECT unnest([30, 60, 90]) AS lead)
    SELECT year::BIGINT AS year, lead::BIGINT AS lead_days, strftime(make_date(year, 11, 1) + lead * INTERVAL 1 DAY, '%Y-%m-%d')
        AS target_date, (lead * 24 // 6)::BIGINT AS steps FROM y, l""",
)
def target_dates(spark: SparkSession, sf: str) -> DataFrame:
    years = T.load(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    out = years.withColumn("lead_days", F.explode(F.array(F.lit(30), F.lit(60), F.lit(90))))
    target = temporal.target_date(F.col("year"), F.col("lead_days"))
    out = out.withColumn("target_date", day(target)).withColumn("steps", temporal.steps_to(F.make_date("year", F.lit(11), F.lit(1)).cast("timestamp_ntz"), target.cast("timestamp_ntz")))
    return _long(out, "year", "lead_days", "steps")


@query(
    "calendar_fallback",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), d AS (SELECT y, coalesce(try_cast(y || '-02-29' AS DATE),
        make_date(y, 2, 28)) AS d FROM y)
    SELECT y::BIGINT AS year, strftime(d, '%Y-%m-%d') AS leap_or_28, strftime(date_trunc('month', d), '%Y-%m-%d') AS first_day,
    strftime(last_day(d), '%Y-%m-%d') AS last_day,
    (CASE WHEN day(last_day(d)) = 29 THEN 366 ELSE 365 END * 4)::BIGINT AS n_steps FROM d""",
)
def calendar_fallback(spark: SparkSession, sf: str) -> DataFrame:
    years = T.load(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    d = temporal.same_day(F.col("year"), F.lit(2), F.lit(29))
    steps = F.size(temporal.six_hour_steps(F.col("year")))
    out = years.select("year", day(d).alias("leap_or_28"), day(F.trunc(d, "month")).alias("first_day"), day(F.last_day(d)).alias("last_day"), steps.alias("n_steps"))
    return _long(out, "year", "n_steps")


@query("time_slice_bbox", "SELECT event_id, user_id AS cell, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events WHERE ts "
        "BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 23:59:59' AND user_id BETWEEN 10 AND 90")
def time_slice_bbox(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.time_slice(T.series(spark, sf), "2024-01-05T00:00:00", "2024-01-12T23:59:59").where(F.col("cell").between(10, 90))
    return rows.select("event_id", "cell", clock("ts").alias("ts"), "value")


@query("bounding_box", sql("SELECT cell::BIGINT AS cell, lat, lon FROM grid WHERE lat BETWEEN 18 AND 52 AND lon BETWEEN 195 AND 245", "grid"))
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    cells = T.grid(spark, sf)
    return _long(cells.where(in_box(F.col("lat"), F.col("lon"), (18, 52, 195, 245), 280)), "cell")


for _how in ("max", "min"):

    @query(f"daily_{_how}", sql(f"SELECT cell, strftime(ts, '%Y-%m-%d') AS date, {_how}(value) AS value, count(value) AS n FROM ts GROUP BY ALL", "ts"))
    def daily_value(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        return daily.daily_extreme(T.series(spark, sf), CELL, how=how).withColumn("date", day("date"))


@query("daily_range", sql("SELECT cell, strftime(ts, '%Y-%m-%d') AS date, max(value) AS max_value, min(value) AS min_value, "
        "count(value) AS n FROM ts GROUP BY ALL", "ts"))
def daily_range(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_range(T.series(spark, sf), CELL).withColumn("date", day("date"))


@query(
    "valid_time_6h",
    sql(
        """SELECT cell, event_id, (row_number() OVER w - 1)::BIGINT AS step, strftime(TIMESTAMP '2024-01-01 00:00:00' + (6 + 6 *
            (row_number() OVER w - 1)) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS valid_time,
        strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS micro_time FROM ts
        WINDOW w AS (PARTITION BY cell ORDER BY ts, event_id)""",
        "ts",
    ),
)
def valid_time_6h(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.series(spark, sf).withColumn("init", temporal.ntz("2024-01-01T00:00:00"))
    out = daily.positional_times(rows, CELL, ["ts", "event_id"], "init")
    micro = temporal.valid_time(F.col("init"), F.col("event_id") * 1000000, "microseconds")
    return _long(out.select("cell", "event_id", "step", clock("valid_time").alias("valid_time"), clock(micro).alias("micro_time")), "step")


@query("last_step", sql("SELECT cell, max_by(value, (ts, event_id)) AS value FROM ts GROUP BY cell", "ts"))
def last_step(spark: SparkSession, sf: str) -> DataFrame:
    return daily.last_step(T.series(spark, sf), CELL, ["ts", "event_id"])


@query("first_step", sql("SELECT cell, min_by(value, (ts, event_id)) AS value FROM ts GROUP BY cell", "ts"))
def first_step(spark: SparkSession, sf: str) -> DataFrame:
    return daily.first_step(T.series(spark, sf), CELL, ["ts", "event_id"])


@query("to_celsius", sql("SELECT event_id, round(CASE WHEN (SELECT avg(value + 200) FROM ts) > 100 THEN value + 200 - 273.15 ELSE "
        "value + 200 END, 6) AS value FROM ts", "ts"))
def to_celsius(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.series(spark, sf).select("event_id", (F.col("value") + 200).alias("value"))
    return daily.to_celsius(rows, "value").select("event_id", r6("value").alias("value"))


@query("kelvin_offset", sql("SELECT event_id, round(value + 200 - 273.15, 6) AS value FROM ts", "ts"))
def kelvin_offset(spark: SparkSession, sf: str) -> DataFrame:
    return T.series(spark, sf).select("event_id", r6(daily.celsius(F.col("value") + 200)).alias("value"))


@query("month_filter", sql("SELECT cell::BIGINT AS cell, strftime(date, '%Y-%m-%d') AS date, value FROM obd WHERE month(date) = 4", "obd"))
def month_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _long(T.observed_daily(spark, sf).where(F.month("date") == 4).withColumn("date", day("date")), "cell")


# --- climatology ---------------------------------------------------------------------------


@query("clim_mean", sql("SELECT cell::BIGINT AS cell, round(avg(value), 6) AS baseline FROM obd GROUP BY cell", "obd"))
def clim_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _long(climatology.mean_of(T.observed_daily(spark, sf), CELL).withColumn("baseline", r6("baseline")), "cell")


for _name, _q in (("threshold_p90", Q90), ("threshold_p10", Q10)):

    @query(_name, sql(f"SELECT cell::BIGINT AS cell, round(quantile_cont(value, {_q}), 6) AS threshold, count(*) AS n_samples FROM "
            f"obd GROUP BY cell", "obd"))
    def threshold(spark: SparkSession, sf: str, q: float = _q) -> DataFrame:
        return _long(climatology.threshold(T.observed_daily(spark, sf), CELL, q).withColumn("threshold", r6("threshold")), "cell")


@query("anomaly_threshold_p90", sql("SELECT cell::BIGINT AS cell, round(avg(value), 6) AS baseline, round(quantile_cont(value, "
        "0.9) - avg(value), 6) AS threshold, count(*) AS n_samples FROM obd GROUP BY cell", "obd"))
def anomaly_threshold_p90(spark: SparkSession, sf: str) -> DataFrame:
    out = climatology.anomaly_threshold(T.observed_daily(spark, sf), CELL, Q90)
    return _long(out.withColumn("baseline", r6("baseline")).withColumn("threshold", r6("threshold")), "cell")


@query(
    "window_climatology",
    sql(
        """, w AS (SELECT target, c + d * INTERVAL 1 DAY AS date FROM (SELECT t.target, coalesce(try_cast(y || strftime(t.target,
            '-%m-%d') AS DATE), make_date(y, 2, 28)) AS c
            FROM (SELECT DATE '2000-01-01' AS target UNION ALL SELECT DATE '2000-02-29') t, range(1996, 2001) AS r(y)), range(-15, 16) AS s(d))
        SELECT strftime(target, '%Y-%m-%d') AS target, cell::BIGINT AS cell, round(avg(value), 6) AS baseline,
        round(quantile_cont(value, 0.9) - avg(value), 6) AS threshold, count(*) AS n_samples
        FROM w JOIN obd ON obd.date = w.date::DATE GROUP BY ALL""",
        "obd",
    ).replace("\n, w AS", ", w AS"),
)
def window_climatology(spark: SparkSession, sf: str) -> DataFrame:
    targets = spark.createDataFrame([("2000-01-01",), ("2000-02-29",)], "target string").select(F.to_date("target").alias("target"))
    out = climatology.window_climatology(T.observed_daily(spark, sf), targets, CELL, 15, F.lit(1996), F.lit(2000), Q90)
    return _long(out.select(day("target").alias("target"), "cell", r6("baseline").alias("baseline"), r6("threshold").alias("threshold"), "n_samples"), "cell")


@query(
    "window_months",
    """WITH t AS (SELECT min(o_orderdate)::DATE AS target FROM orders UNION SELECT DATE '2000-02-29' FROM orders WHERE o_orderdate::DATE = DATE '2000-02-29'
        UNION SELECT max(o_orderdate)::DATE FROM orders), y AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders),
    c AS (SELECT target, coalesce(try_cast(i || strftime(target, '-%m-%d') AS DATE), make_date(i, 2, 28)) AS c FROM t, y, range(1900, 2100) AS r(i) WHERE i BETWEEN a AND b)
    SELECT DISTINCT strftime(target, '%Y-%m-%d') AS target, year(c + d * INTERVAL 1 DAY)::BIGINT AS year, month(c + d * INTERVAL 1
        DAY)::BIGINT AS month FROM c, range(-15, 16) AS s(d)""",
)
def window_months(spark: SparkSession, sf: str) -> DataFrame:
    dates = T.load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("target"))
    ends = dates.agg(F.min("target").alias("a"), F.max("target").alias("b"), F.max(F.when(F.col("target") == "2000-02-29", F.col("target"))).alias("c"))
    targets = ends.select(F.year("a").alias("first"), F.year("b").alias("last"), F.explode(F.array_compact(F.array("a", "b", "c"))).alias("target")).distinct()
    out = climatology.window_months(targets, 15, F.col("first"), F.col("last"))
    return _long(out.withColumn("target", day("target")), "year", "month")


@query("global_p90", "SELECT round(quantile_cont(l_extendedprice, 0.9), 6) AS threshold, count(l_extendedprice) AS n_samples FROM lineitem")
def global_p90(spark: SparkSession, sf: str) -> DataFrame:
    """One key with all rows, by rounds of counts."""
    out = climatology.exact_quantile(T.load(spark, sf, "lineitem"), [], Q90, "l_extendedprice")
    return out.withColumn("threshold", r6("threshold"))


@query("flag_p10", "SELECT l_returnflag AS flag, round(quantile_cont(l_discount, 0.1), 6) AS threshold, count(l_discount) AS n_samples FROM lineitem GROUP BY 1")
def flag_p10(spark: SparkSession, sf: str) -> DataFrame:
    """Few keys with many equal values."""
    out = climatology.exact_quantile(T.load(spark, sf, "lineitem"), ["l_returnflag"], Q10, "l_discount")
    return out.select(F.col("l_returnflag").alias("flag"), r6("threshold").alias("threshold"), "n_samples")


# --- ensemble events -----------------------------------------------------------------------


@query("event_probability", sql("SELECT cell::BIGINT AS cell, year::BIGINT AS year, round(probability, 6) AS probability, "
        "n_members::BIGINT AS n_members FROM prob", "prob"))
def event_probability(spark: SparkSession, sf: str) -> DataFrame:
    return _long(probabilities(spark, sf).select("cell", "year", r6("probability").alias("probability"), "n_members"), "cell", "year")


@query(
    "event_probability_cold",
    sql("SELECT cell::BIGINT AS cell, year::BIGINT AS year, round(avg(CASE WHEN value < cold THEN 1.0::DOUBLE ELSE 0 END), 6) AS "
            "probability, count(*)::BIGINT AS n_members FROM fc JOIN fct USING (cell) GROUP BY cell, year", "fct"),
)
def event_probability_cold(spark: SparkSession, sf: str) -> DataFrame:
    return _long(probabilities(spark, sf, "cold").select("cell", "year", r6("probability").alias("probability"), "n_members"), "cell", "year")


@query("ensemble_uncertainty", sql("SELECT cell::BIGINT AS cell, year::BIGINT AS year, round(spread, 6) AS spread FROM prob", "prob"))
def ensemble_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    return _long(probabilities(spark, sf).select("cell", "year", r6("spread").alias("spread")), "cell", "year")


@query("ensemble_mean_anomaly", sql("SELECT cell::BIGINT AS cell, year::BIGINT AS year, round(ens_mean, 6) AS ensemble_mean, "
        "round(ens_anomaly, 6) AS anomaly FROM prob", "prob"))
def ensemble_mean_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    out = extremes.ensemble_mean_anomaly(forecasts(spark, sf), None, CELL, CASE)
    return _long(out.withColumn("ensemble_mean", r6("ensemble_mean")).withColumn("anomaly", r6("anomaly")), "cell", "year")


@query("forecast_error", sql("SELECT cell::BIGINT AS cell, year::BIGINT AS year, observed, round(observed - probability, 6) AS error FROM po", "po"))
def forecast_error(spark: SparkSession, sf: str) -> DataFrame:
    return _long(pairs(spark, sf).select("cell", "year", "observed", r6(F.col("observed") - F.col("probability")).alias("error")), "cell", "year")


@query("ensmean_binary", sql("SELECT cell::BIGINT AS cell, year::BIGINT AS year, CASE WHEN ens_anomaly > hot - baseline THEN "
        "1.0::DOUBLE ELSE 0 END AS event FROM prob", "prob"))
def ensmean_binary(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.first(F.col("hot") - F.col("baseline")).alias("hot_anomaly_threshold_C")
    mean = extremes.ensemble_mean_anomaly(forecasts(spark, sf), None, CELL, CASE, also=(limit,))
    out = plots.mean_event(mean.withColumnRenamed("anomaly", "predicted_tmax_anomaly_C_ensmean"))
    return _long(out.select("cell", "year", F.col("ensemble_mean_event").alias("event")), "cell", "year")


_FIELD_SQL = ("hit", "o_hit", "p", "o_hit - p", "sp", "b", "t", "m", "ma", "m0", "m0a", "o", "oa")


@query(
    "extremes_13_fields",
    sql(
        """, a AS (SELECT cell, year, sample, value, value - baseline AS an, baseline AS b, hot - baseline AS t, CASE WHEN value -
            baseline > hot - baseline THEN 1.0::DOUBLE ELSE 0 END AS hit FROM fc JOIN fct USING (cell)),
        c AS (SELECT cell, year, avg(hit) AS p, stddev_pop(hit) AS sp, avg(value) AS m, avg(an) AS ma, min_by(value, sample) AS
        m0, min_by(an, sample) AS m0a FROM a GROUP BY ALL),
        o AS (SELECT cell, year, value AS o, anomaly AS oa, CASE WHEN anomaly > hot - baseline THEN 1.0::DOUBLE ELSE 0 END AS o_hit FROM oev)
        SELECT a.cell::BIGINT AS cell, a.year::BIGINT AS year, sample::BIGINT AS sample, """
        + ", ".join(f"round({e}, 6) AS \"{n}\"" for n, e in zip(extremes.FIELDS, _FIELD_SQL))
        + " FROM a JOIN c ON a.cell = c.cell AND a.year = c.year JOIN o ON a.cell = o.cell AND a.year = o.year",
        "fct", "oev",
    ).replace("\n, a AS", ", a AS"),
)
def extremes_13_fields(spark: SparkSession, sf: str) -> DataFrame:
    anomaly = (F.col("hot") - F.col("baseline")).alias("threshold")
    fc = forecasts(spark, sf).select(*CELL, *CASE, "sample", "value", "baseline", anomaly)
    obs = T.observed_yearly(climatology.with_climate(T.observed_daily(spark, sf), CELL, Q90, Q10), "baseline", "hot")
    out = extremes.extremes_fields(fc, obs.select(*CELL, *CASE, "value", "baseline", anomaly), None, None, CELL, CASE)
    return _long(out.select("cell", "year", "sample", *[r6(n).alias(n) for n in extremes.FIELDS]), "cell", "year", "sample")


# --- scores --------------------------------------------------------------------------------

_BS, _REF = "avg(pow(probability - observed, 2))", "var_pop(observed)"
_R = "covar_pop(probability, observed) / nullif(stddev_pop(probability) * stddev_pop(observed), 0)"


def _scores(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return _long(verification.case_metrics(pairs(spark, sf), CASE, forecast="fc_anomaly", truth="ob_anomaly").select("year", *[r6(n).alias(n) for n in names]), "year")


def _score_query(name: str, **columns: str) -> None:
    body = ", ".join(f"round({e}, 6) AS \"{c}\"" for c, e in columns.items())

    @query(name, sql(f"SELECT year::BIGINT AS year, {body} FROM po GROUP BY year", "po"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _scores(spark, sf, *columns)


_METRICS = {
    "frac_obs_extreme": "avg(observed)", "mean_pred_prob": "avg(probability)", "brier_score": _BS, "brier_skill_score": f"1 - {_BS} / nullif({_REF}, 0)", "spatial_corr_prob_obs": _R,
    "pred_tmax_bias_C": "avg(ens_anomaly - obs_anomaly)", "pred_tmax_rmse_C": "sqrt(avg(pow(ens_anomaly - obs_anomaly, 2)))",
}
for _name, _columns in {
    "brier_by_year": ["brier_score"], "bss_by_year": ["brier_score", "brier_skill_score"], "pearson_prob_obs": ["spatial_corr_prob_obs"],
    "bias_rmse": ["pred_tmax_bias_C", "pred_tmax_rmse_C"], "case_metrics": list(_METRICS),
}.items():
    _score_query(_name, **{c: _METRICS[c] for c in _columns})


def _skill_query(name: str, oracle: str | None, *columns: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _long(skill(spark, sf).select("cell", *[c if c == "n" else r6(c).alias(c) for c in columns]), "cell")


_skill_query("brier_cell", sql("SELECT cell::BIGINT AS cell, n::BIGINT AS n, round(brier, 6) AS brier FROM sk", "sk"), "n", "brier")
_skill_query("spearman_cell", sql("SELECT cell::BIGINT AS cell, n::BIGINT AS n, round(rho, 6) AS rho FROM sk", "sk"), "n", "rho")
_skill_query("spearman_p_cell", sql(f"SELECT cell::BIGINT AS cell, round(rho, 6) AS rho, round({RHO_P}, 6) AS rho_p FROM sk", "sk"), "rho", "rho_p")
_skill_query("kendall_cell", sql("SELECT cell::BIGINT AS cell, n::BIGINT AS n, round(tau, 6) AS tau FROM sk", "sk"), "n", "tau")
_skill_query("kendall_z_cell", sql("SELECT cell::BIGINT AS cell, round(tau, 6) AS tau, CASE WHEN tau IS NOT NULL THEN round(s / "
        "nullif(sqrt(var), 0), 6) END AS tau_z FROM sk", "sk"), "tau", "tau_z")
_skill_query("kendall_p_cell", sql(f"SELECT cell::BIGINT AS cell, round(tau, 6) AS tau, round(z, 6) AS tau_z, round({Z_P}, 6) AS "
        f"tau_p FROM skz", "skz"), "tau", "tau_z", "tau_p")
_skill_query(
    "skill_table",
    sql(
        f"""SELECT cell::BIGINT AS cell, n::BIGINT AS n, round(brier, 6) AS brier, round(rho, 6) AS rho, round({RHO_P}, 6) AS rho_p,
        round(tau, 6) AS tau, round(z, 6) AS tau_z, round({Z_P}, 6) AS tau_p FROM skz""",
        "skz",
    ),
    *("n", "brier", "rho", "rho_p", "tau", "tau_z", "tau_p"),
)


@query("area_weighted_mean", sql("SELECT round(sum(brier * cos(radians(lat))) / sum(cos(radians(lat))), 6) AS brier_mean, "
        "round(sum(rho * cos(radians(lat))) / sum(CASE WHEN rho IS NOT NULL THEN cos(radians(lat)) END), 6) AS rho_mean FROM sk "
        "JOIN grid USING (cell)", "sk", "grid"))
def area_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = verification.area_means(skill(spark, sf).join(T.grid(spark, sf), "cell"), ["brier", "rho"])
    return out.select(r6("brier_mean").alias("brier_mean"), r6("rho_mean").alias("rho_mean"))


@query("area_mean_by_year", sql("SELECT year::BIGINT AS year, round(sum(probability * cos(radians(lat))) / sum(cos(radians(lat))), "
        "6) AS area_mean FROM prob JOIN grid USING (cell) GROUP BY year", "prob", "grid"))
def area_mean_by_year(spark: SparkSession, sf: str) -> DataFrame:
    out = verification.area_mean(probabilities(spark, sf).join(T.grid(spark, sf), "cell"), CASE, "probability")
    return _long(out.withColumn("area_mean", r6("area_mean")), "year")


@query(
    "stipple_counts",
    sql(
        f"""SELECT count(*) AS n_cells, count_if(coalesce(p > 0.05, false))::BIGINT AS rho_stippled, count_if(coalesce(q > 0.05,
            false))::BIGINT AS tau_stippled,
        count_if(brier > 0.09)::BIGINT AS brier_stippled FROM (SELECT brier, {RHO_P} AS p, {Z_P} AS q FROM skz)""",
        "skz",
    ),
)
def stipple_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = verification.stippled(skill(spark, sf))
    marks = [F.count_if(f"{c}_stipple").alias(f"{c}_stippled") for c in ("rho", "tau", "brier")]
    return rows.agg(F.count("*").alias("n_cells"), *marks)


@query("yearly_means", sql("SELECT year::BIGINT AS year, round(avg(observed), 6) AS obs_frac, round(avg(probability), 6) AS "
        "pred_prob_mean, count(*) AS n_cells FROM po GROUP BY year", "po"))
def yearly_means(spark: SparkSession, sf: str) -> DataFrame:
    out = verification.case_metrics(pairs(spark, sf), CASE)
    return _long(out.select("year", r6("frac_obs_extreme").alias("obs_frac"), r6("mean_pred_prob").alias("pred_prob_mean"), "n_cells"), "year")


# --- grids, members, files -----------------------------------------------------------------


@query(
    "regrid_nearest",
    sql(
        """, t AS (SELECT unnest([25.0::DOUBLE, 37.0, 52.0]) AS lat), u AS (SELECT unnest([205.0::DOUBLE, 230.0, 271.0]) AS lon),
        la AS (SELECT t.lat, arg_min(g.lat, (abs(g.lat - t.lat), -g.lat)) AS s FROM t, (SELECT DISTINCT lat FROM grid) g GROUP BY t.lat),
        lo AS (SELECT u.lon, arg_min(g.lon, (abs(g.lon - u.lon), -g.lon)) AS s FROM u, (SELECT DISTINCT lon FROM grid) g GROUP BY u.lon)
        SELECT la.lat, lo.lon, grid.cell::BIGINT AS cell FROM la, lo JOIN grid ON grid.lat = la.s AND grid.lon = lo.s""",
        "grid",
    ).replace("\n, t AS", ", t AS"),
)
def regrid_nearest(spark: SparkSession, sf: str) -> DataFrame:
    template = spark.createDataFrame([(a, o) for a in (25.0, 37.0, 52.0) for o in (205.0, 230.0, 271.0)], "lat double, lon double")
    return _long(regrid.to_template(T.grid(spark, sf), template), "cell")


@query("lon_normalise", sql("SELECT cell::BIGINT AS cell, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon FROM grid", "grid"))
def lon_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _long(T.grid(spark, sf).select("cell", signed_longitude(F.col("lon")).alias("lon")), "cell")


@query("member_chunks", "SELECT ((l_linenumber - 1) // 5)::BIGINT AS chunk, min(l_linenumber - 1)::BIGINT AS first_sample, "
        "count(DISTINCT l_linenumber)::BIGINT AS n_members FROM lineitem GROUP BY 1")
def member_chunks(spark: SparkSession, sf: str) -> DataFrame:
    members = T.load(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).alias("sample"))
    return _long(planning.member_chunks(members, 5), "chunk", "first_sample", "n_members")


@query("member_pick", "WITH n AS (SELECT count(DISTINCT l_linenumber) AS n FROM lineitem) SELECT DISTINCT floor(i * (n - 1) / "
        "(least(n, 4) - 1))::BIGINT AS sample FROM n, range(4) AS r(i) WHERE i < least(n, 4)")
def member_pick(spark: SparkSession, sf: str) -> DataFrame:
    totals = T.load(spark, sf, "lineitem").agg(F.count_distinct("l_linenumber").alias("total"))
    return _long(planning.pick_of(totals, 4), "sample")


@query("member_pick_31_of_12", "WITH n AS (SELECT count(DISTINCT day(l_shipdate)) AS n FROM lineitem) SELECT DISTINCT CASE WHEN i = 11 "
        "THEN n - 1 ELSE floor(i * ((n - 1) / 11.0::DOUBLE)) END::BIGINT AS sample FROM n, range(12) AS r(i)")
def member_pick_31_of_12(spark: SparkSession, sf: str) -> DataFrame:
    """The days of the month as members, 31 of them."""
    totals = T.load(spark, sf, "lineitem").agg(F.count_distinct(F.dayofmonth("l_shipdate")).alias("total"))
    return _long(planning.pick_of(totals, 12), "sample")


@query("concat_samples", "SELECT (CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber - 1 ELSE l_linenumber + 4 END)::BIGINT AS sample, "
        "count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def concat_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("sample"), "l_extendedprice")
    out = planning.stack_samples([rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 <> 0")], chunk=5)
    return _long(out.groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")), "sample")


@query("missing_partitions", "SELECT DISTINCT year(l_shipdate)::BIGINT AS year, month(l_shipdate)::BIGINT AS month FROM lineitem "
        "EXCEPT SELECT year(o_orderdate)::BIGINT, month(o_orderdate)::BIGINT FROM orders")
def missing_partitions(spark: SparkSession, sf: str) -> DataFrame:
    months = lambda t, c: T.load(spark, sf, t).select(F.year(c).alias("year"), F.month(c).alias("month")).distinct()
    return _long(planning.missing(months("lineitem", "l_shipdate"), months("orders", "o_orderdate"), ["year", "month"]), "year", "month")


@query("completeness_check", sql("SELECT cell::BIGINT AS cell, count(DISTINCT sample)::BIGINT AS n_members, count(DISTINCT "
        "year)::BIGINT AS n_steps, count(DISTINCT year) >= 7 AND count(DISTINCT sample) = 7 AS complete FROM fc GROUP BY cell", "fc"))
def completeness_check(spark: SparkSession, sf: str) -> DataFrame:
    return _long(planning.completeness(T.forecast(spark, sf), CELL, "sample", "year", 7, 7), "cell", "n_members", "n_steps")


@query("required_names", "SELECT p_brand, (count(*) FILTER (p_size = 1) > 0 AND count(*) FILTER (p_size = 2) > 0 AND count(*) "
        "FILTER (p_size = 3) > 0) AS has_all FROM part GROUP BY p_brand")
def required_names(spark: SparkSession, sf: str) -> DataFrame:
    sizes = T.load(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("have"))
    return sizes.select("p_brand", planning.has_columns(F.col("have"), ["1", "2", "3"]).alias("has_all"))


@query("plot_limits", sql("SELECT year::BIGINT AS year, round(least(min(ens_anomaly), min(obs_anomaly)), 6) AS low, "
        "round(greatest(max(ens_anomaly), max(obs_anomaly)), 6) AS high, round(greatest(max(abs(ens_anomaly)), "
        "max(abs(obs_anomaly))), 6) AS abs_high FROM po GROUP BY year", "po"))
def plot_limits(spark: SparkSession, sf: str) -> DataFrame:
    out = plots.limits(pairs(spark, sf), CASE, "fc_anomaly", "ob_anomaly")
    return _long(out.select("year", *[r6(c).alias(c) for c in ("low", "high", "abs_high")]), "year")


@query("skill_map", sql("SELECT lat, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, CASE WHEN rho >= 0 THEN round(rho, 6) "
        "END AS value, coalesce(p > 0.05, false) AS stipple FROM (SELECT "
        "cell, rho, " + RHO_P + " AS p FROM sk) JOIN grid USING (cell)", "sk", "grid"))
def skill_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = verification.stippled(skill(spark, sf)).join(T.grid(spark, sf), "cell")
    return plots.skill_map(rows, "rho", "rho_stipple").withColumn("value", r6("value"))


_PANEL_VIEW = """, o AS (SELECT cell, year, probability, observed, spread, obs_value, obs_anomaly FROM po),
        m AS (SELECT cell, year, min_by(value, sample) AS m0, min_by(value - baseline, sample) AS m0a FROM fc JOIN fct USING (cell) GROUP BY ALL)
        SELECT cell::BIGINT AS cell, year::BIGINT AS year, panel::BIGINT AS panel, field, round(value, 6) AS value, round(low, 6)
            AS low, round(high, 6) AS high FROM ("""


def _panel_query(name: str, run: Callable[[DataFrame], DataFrame], *selects: str) -> None:
    @query(name, sql((_PANEL_VIEW + " UNION ALL ".join(selects) + ")"), "po").replace("\n, o AS", ", o AS"))
    def rows(spark: SparkSession, sf: str) -> DataFrame:
        fields = extremes_13_fields(spark, sf)
        return run(fields).select("cell", "year", F.col("panel").cast("long").alias("panel"), "field", *[r6(c).alias(c) for c in ("value", "low", "high")])


def _panel_sql(place: int, field: str, value: str, low: object, high: object) -> str:
    end = lambda x: "NULL::DOUBLE" if x is None else f"({x})::DOUBLE"
    return f"SELECT cell, year, {place} AS panel, '{field}' AS field, {value} AS value, {end(low)} AS low, {end(high)} AS high FROM o JOIN m USING (cell, year)"


_PANEL_VALUES = {
    "predicted_hot_extreme_probability": "probability", "observed_hot_extreme": "observed", "ensemble_uncertainty": "spread", "prediction_error_observed_minus_predicted": "observed - probability",
    "observed_daily_tmax_C": "obs_value", "predicted_daily_tmax_C_member0": "m0", "observed_tmax_anomaly_C": "obs_anomaly", "predicted_tmax_anomaly_C_member0": "m0a",
}
for _name, _spec in (("event_panels", plots.EVENT_PANELS), ("summary_panels", plots.SUMMARY_PANELS)):
    _panel_query(_name, lambda f, spec=_spec: plots.panels(f, [*CELL, *CASE], spec), *[_panel_sql(i, f, _PANEL_VALUES[f], a, b) for i, (f, _, a, b) in enumerate(_spec)])
_OVER = "OVER (PARTITION BY year)"
_ENDS = {
    "shared": (f"least(min(obs_value) {_OVER}, min(m0) {_OVER})", f"greatest(max(obs_value) {_OVER}, max(m0) {_OVER})"),
    "mirrored": tuple(f"{sign}greatest(max(abs(obs_anomaly)) {_OVER}, max(abs(m0a)) {_OVER})" for sign in ("-", "")),
}
_panel_query("temperature_panels", lambda f: plots.temperature_panels(f, [*CELL, *CASE], CASE), *[_panel_sql(i, f, _PANEL_VALUES[f], *_ENDS[k]) for i, (f, _, k) in enumerate(plots.TEMPERATURE_PANELS)])


@query(
    "member_maps",
    sql(
        """SELECT cell::BIGINT AS cell, fc.year::BIGINT AS year, sample::BIGINT AS sample, CASE WHEN fc.value > fct.hot THEN 1.0::DOUBLE ELSE 0 END AS predicted_hot_extreme
        FROM fc JOIN fct USING (cell) JOIN oev USING (cell, year) WHERE sample IN (0, 2, 4, 6)""",
        "fct", "oev",
    ),
)
def member_maps(spark: SparkSession, sf: str) -> DataFrame:
    return plots.member_maps(extremes_13_fields(spark, sf), planning.pick_members(spark, 7, 4), [*CELL, *CASE])


@query(
    "skill_maps_saved",
    sql(
        """SELECT 'heat' AS extreme, '030d' AS lead, lat, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, round(brier, 6) AS value, brier > 0.09 AS stipple
        FROM sk JOIN grid USING (cell)""",
        "sk", "grid",
    ),
)
def skill_maps_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the skill table as the command does, and reads the maps from what it wrote."""
    folder = sinks.scratch_folder(spark, "skill")
    sinks.write_skill(skill(spark, sf).join(T.grid(spark, sf), "cell"), folder, "heat", "030d", threshold_pct=90)
    return plots.skill_maps(readers.read_skill(spark, folder), "brier").withColumn("value", r6("value"))


@query("case_counts", sql("SELECT count(*) AS n_cases, count(DISTINCT year) AS n_years, count(DISTINCT cell) AS n_cells FROM po", "po"))
def case_counts(spark: SparkSession, sf: str) -> DataFrame:
    return planning.case_counts(pairs(spark, sf), CASE, CELL)


@query("exact_date", sql("SELECT cell::BIGINT AS cell, strftime(date, '%Y-%m-%d') AS date, value FROM obd WHERE date = (SELECT min(date) FROM obd)", "obd"))
def exact_date(spark: SparkSession, sf: str) -> DataFrame:
    first = T.load(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("date"))
    return _long(daily.on_date(T.observed_daily(spark, sf), first).withColumn("date", day("date")), "cell")


@query(
    "valid_time_units",
    """SELECT event_id, strftime(TIMESTAMP '2000-02-28 06:00:00' + to_hours(event_id::INT), '%Y-%m-%d %H:%M:%S') AS by_hours,
    strftime(TIMESTAMP '2000-02-28 06:00:00' + to_days(event_id::INT), '%Y-%m-%d %H:%M:%S') AS by_days, strftime(ts, '%Y-%m-%d %H:%M:%S') AS absolute,
    strftime(TIMESTAMP '2000-02-28 06:00:00' + to_minutes(event_id::INT), '%Y-%m-%d %H:%M:%S') AS by_interval FROM events""",
)
def valid_time_units(spark: SparkSession, sf: str) -> DataFrame:
    rows, init, i = T.series(spark, sf), temporal.ntz("2000-02-28T06:00:00"), F.col("event_id")
    times = {
        "by_hours": temporal.valid_time(init, i, "hours"),
        "by_days": temporal.valid_time(init, i, "days"),
        "absolute": temporal.valid_time(init, F.col("ts"), "datetime"),
        "by_interval": temporal.valid_time(init, F.make_dt_interval(mins=i.cast("int")), "timedelta"),
    }
    return rows.select("event_id", *[clock(t).alias(n) for n, t in times.items()])


@query(
    "valid_time_of_axes",
    """SELECT event_id, strftime(TIMESTAMP '2000-02-28 06:00:00' + to_microseconds(event_id * 60000000), '%Y-%m-%d %H:%M:%S') AS by_micros,
    strftime(TIMESTAMP '2000-02-28 06:00:00' + to_hours(event_id::INT), '%Y-%m-%d %H:%M:%S') AS by_hours,
    strftime(TIMESTAMP '1940-01-01 12:00:00' + to_hours(event_id::INT), '%Y-%m-%d %H:%M:%S') AS by_reference,
    strftime(TIMESTAMP '2000-02-28 06:00:00' + to_hours((6 + 6 * (dense_rank() OVER (ORDER BY hour(ts)) - 1))::INT), '%Y-%m-%d %H:%M:%S') AS by_place FROM events""",
)
def valid_time_of_axes(spark: SparkSession, sf: str) -> DataFrame:
    """One axis in four ways to write it: the units in its metadata choose the branch."""
    out, init = T.series(spark, sf).select("event_id", "ts"), temporal.ntz("2000-02-28T06:00:00")
    axes = {
        "by_micros": (F.col("event_id") * 60_000_000, {"units": "microseconds"}), "by_hours": (F.col("event_id"), {"units": "hours"}),
        "by_reference": (F.col("event_id"), {"units": "hours since 1940-01-01T12:00:00"}), "by_place": (F.hour("ts"), {}),
    }
    for name, (axis, told) in axes.items():
        out = daily.with_valid_time(out.withColumn("axis", axis).withMetadata("axis", told), init, "axis", name).withColumn(name, clock(name)).drop("axis")
    return out.drop("ts")


LEADS, LEAD_MONTHS = {"030d": 30, "060d": 60, "090d": 90}, {"030d": 12, "060d": 12, "090d": 1}
VIEWS |= {
    "lagdays": "SELECT c_nationkey % 5 AS cell, o_orderdate::DATE AS date, max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders JOIN customer "
    "ON o_custkey = c_custkey GROUP BY ALL",
    "lagfc": "SELECT s_nationkey % 5 AS cell, year(l_shipdate)::INT AS year, l_linenumber - 1 AS sample, 30 * (1 + month(l_shipdate) % 3)::INT AS lead_days, "
    "5 * max_by(l_extendedprice, (l_shipdate, l_orderkey, l_extendedprice)) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "lagl": "SELECT * FROM (VALUES ('030d', 30, 12), ('060d', 60, 12), ('090d', 90, 1)) AS v(lead, lead_days, month)",
    "lagcl": "SELECT lead, lead_days, cell, quantile_cont(high, 0.9) AS hot, quantile_cont(low, 0.1) AS cold FROM lagdays JOIN lagl ON month(date) = lagl.month "
    "WHERE year(date) BETWEEN 1995 AND 2001 GROUP BY ALL",
    "lagp": "SELECT lead, cell, year, avg((value > hot)::INT) AS heat, avg((value < cold)::INT) AS cold FROM lagfc JOIN lagcl USING (lead_days, cell) GROUP BY ALL",
    "lago": "SELECT lead, cell, (year(date - lead_days))::INT AS year, (high > hot)::INT::DOUBLE AS heat, (low < cold)::INT::DOUBLE AS cold FROM lagdays JOIN lagcl USING (cell) "
    "WHERE month(date - lead_days) = 11 AND day(date - lead_days) = 1",
    "lagpo": "SELECT extreme, lead, cell, p, o, row_number() OVER (PARTITION BY extreme, lead, cell ORDER BY year) AS i FROM (SELECT 'heat' AS extreme, lead, cell, year, a.heat "
    "AS p, b.heat AS o FROM lagp a JOIN lago b USING (lead, cell, year) UNION ALL SELECT 'cold', lead, cell, year, a.cold, b.cold FROM lagp a JOIN lago b USING (lead, cell, year))",
    "lagr": "SELECT extreme, lead, cell, count(*) AS n, avg((p - o) * (p - o)) AS brier, stddev_pop(o) AS std FROM lagpo GROUP BY ALL",
    "lags": "SELECT a.extreme, a.lead, a.cell, sum(sign(a.p - b.p) * sign(a.o - b.o))::DOUBLE AS s, count_if(a.p = b.p)::DOUBLE AS ptie, count_if(a.o = b.o)::DOUBLE AS otie, "
    "count(*)::DOUBLE AS pairs FROM lagpo a JOIN lagpo b ON a.extreme = b.extreme AND a.lead = b.lead AND a.cell = b.cell AND a.i < b.i GROUP BY ALL",
}
_NEEDS |= {"lagcl": ["lagdays", "lagl"], "lagp": ["lagfc", "lagcl"], "lago": ["lagdays", "lagcl"], "lagpo": ["lagp", "lago"], "lagr": ["lagpo"], "lags": ["lagpo"]}


@query(
    "skill_all_leads",
    sql(
        """SELECT extreme, lead, cell::BIGINT AS cell, n::BIGINT AS n, round(brier, 6) AS brier, CASE WHEN std > 0 THEN round(s / nullif(sqrt((pairs - ptie) * (pairs - otie)), 0), 6) END AS tau
        FROM lagr LEFT JOIN lags USING (extreme, lead, cell)""",
        "lagr", "lags",
    ),
)
def skill_all_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of three leads and two extremes from one pass over lines and one over orders."""
    lines = T.load(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate", "l_extendedprice", F.year("l_shipdate").alias("year"), (F.col("l_linenumber") - 1).alias("sample"))
    lines = lines.join(T.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).alias("cell")), "l_suppkey")
    last = 5 * F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_extendedprice"))
    snaps = lines.groupBy("cell", "year", "sample", (30 * (1 + F.month("l_shipdate") % 3)).alias("lead_days")).agg(last.alias("high")).withColumn("low", F.col("high"))
    orders = T.load(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    orders = orders.join(T.load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).alias("cell")), "o_custkey")
    days = orders.groupBy("cell", "date").agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))
    climate = lag.climate_and_observed(days, LEADS, LEAD_MONTHS, list(range(1900, 2100)), (1995, 2001), CELL)
    out = lag.skill_maps(lag.verification_pairs(snaps, climate, CELL), CELL)
    return _long(out.select("extreme", "lead", "cell", "n", r6("brier").alias("brier"), r6("tau").alias("tau")), "cell")


# Analytic fields on the grid of nations, places from 0 to 1.
_SIDE = "SELECT (lat - min(lat) OVER ()) / (max(lat) OVER () - min(lat) OVER ()) AS y, (lon - min(lon) OVER ()) / (max(lon) OVER () - min(lon) OVER ()) AS x, lat, lon FROM grid"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.on_box(T.grid(spark, sf))


@query("synthetic_observation", sql(f"SELECT lat, lon, round(25 + 3 * y + 1.5 * x, 6) AS value FROM ({_SIDE})", "grid"))
def synthetic_observation(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.observation(spark, _grid(spark, sf)).select("lat", "lon", r6("value").alias("value"))


@query("synthetic_climate", sql("SELECT lat, lon, 22.0::DOUBLE AS baseline, 1.0::DOUBLE AS threshold FROM grid", "grid"))
def synthetic_climate(spark: SparkSession, sf: str) -> DataFrame:
    out = synthetic.climate(synthetic.observation(spark, _grid(spark, sf)))
    return out.select("lat", "lon", *[F.col(c).cast("double").alias(c) for c in ("baseline", "threshold")])


@query(
    "synthetic_forecast",
    sql(
        f"""SELECT m::BIGINT AS sample, s::BIGINT AS step, lat, lon, round(294 + 5 * s / 15.0::DOUBLE + 1.5 * sin(pi() * y) + 0.02 * 4, 2) AS value
        FROM ({_SIDE}), range(3) AS a(m), range(16) AS b(s)""",
        "grid",
    ),
)
def synthetic_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = synthetic.forecast(spark, 4, noise=0.0, grid=_grid(spark, sf))
    return _long(rows.select("sample", "step", "lat", "lon", F.round(F.col("TMP2m").cast("double"), 2).alias("value")), "sample", "step")


@query("embedding_long", "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS level, unnest(embedding)::DOUBLE AS "
        "value FROM embeddings")
def embedding_long(spark: SparkSession, sf: str) -> DataFrame:
    rows = planning.levels(T.load(spark, sf, "embeddings"), ["vec_id"], "embedding")
    return _long(rows.withColumn("value", F.col("value").cast("double")), "level")


@query("embedding_stack", "SELECT label::BIGINT AS label, (i - 1)::BIGINT AS level, round(avg(embedding[i]::DOUBLE), 6) AS mean, "
        "max(embedding[i])::DOUBLE AS top FROM embeddings, (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM "
        "embeddings))) AS i) WHERE i <= len(embedding) GROUP BY ALL")
def embedding_stack(spark: SparkSession, sf: str) -> DataFrame:
    rows = planning.levels(T.load(spark, sf, "embeddings"), ["label"], "embedding")
    out = rows.groupBy("label", "level").agg(r6(F.avg(F.col("value").cast("double"))).alias("mean"), F.max("value").cast("double").alias("top"))
    return _long(out, "label", "level")


@query("running_first_last", sql("SELECT cell, strftime(ts, '%Y-%m') AS month, round(first_value(value) OVER w, 6) AS first_value, "
        "count(*) OVER w AS seen, event_id FROM ts WINDOW w AS (PARTITION BY cell, strftime(ts, '%Y-%m') ORDER BY ts, event_id)", "ts"))
def running_first_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.series(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    out = daily.running(rows, ["cell", "month"], ["ts", "event_id"])
    return out.select("cell", "month", r6("first_value").alias("first_value"), "seen", "event_id")


@query("positional_gather", "SELECT event_id, value FROM events WHERE event_id IN (0, 7, 99, 500)")
def positional_gather(spark: SparkSession, sf: str) -> DataFrame:
    return forcing.at_positions(T.series(spark, sf), [500, 0, 7, 99, 7], "event_id").select("event_id", "value")


@query("positional_slice", "SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 300")
def positional_slice(spark: SparkSession, sf: str) -> DataFrame:
    return readers.positions(T.series(spark, sf), 100, 300, "event_id").select("event_id", "value")


@query("template_grid", sql("SELECT DISTINCT lat, lon FROM grid WHERE cell IN (SELECT cell FROM obd)", "grid", "obd"))
def template_grid(spark: SparkSession, sf: str) -> DataFrame:
    return forcing.template(T.observed_daily(spark, sf).select("cell").distinct().join(T.grid(spark, sf), "cell"))


@query("replicate_forcing", "SELECT r_regionkey::BIGINT AS cell, s::BIGINT AS sample FROM region, range(25) AS m(s)")
def replicate_forcing(spark: SparkSession, sf: str) -> DataFrame:
    fields = T.load(spark, sf, "region").select(F.col("r_regionkey").alias("cell"))
    return _long(forcing.replicate(forcing.replicate(fields, temporal.MEMBERS), 3), "cell", "sample")


@query("collapse_time", sql("SELECT cell::BIGINT AS cell, min_by(value, date) AS value FROM obd GROUP BY cell", "obd"))
def collapse_time(spark: SparkSession, sf: str) -> DataFrame:
    return _long(forcing.collapse_time(T.observed_daily(spark, sf), CELL, index="date"), "cell")


@query("substitute_constants", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.5 WHEN 'MACHINERY' THEN -2.0 ELSE "
        "c_acctbal END::DOUBLE AS value FROM customer")
def substitute_constants(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.load(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("value"))
    return forcing.substitute(rows, {"BUILDING": 1.5, "MACHINERY": -2.0}).select("c_custkey", "value")


@query("cf_time", "SELECT event_id, strftime(TIMESTAMP '1940-01-01 12:00:00' + to_hours(event_id::INT), '%Y-%m-%d %H:%M:%S') AS "
        "valid_time FROM events")
def cf_time(spark: SparkSession, sf: str) -> DataFrame:
    return T.series(spark, sf).select("event_id", clock(temporal.cf_time(F.col("event_id"), "hours since 1940-01-01T12:00:00")).alias("valid_time"))


@query(
    "chunk_manifest",
    """WITH m AS (SELECT DISTINCT l_linenumber - 1 AS s FROM lineitem), k AS (SELECT s // 5 AS c, count(*) AS members FROM m GROUP BY 1),
    t AS (SELECT make_date(1995 + r_regionkey, 4, 1) AS target FROM region)
    SELECT strftime(target, '%Y-%m-%d') AS target_date, lead::BIGINT AS lead_days, c::BIGINT AS chunk, members::BIGINT AS members,
    'runs/' || strftime(target, '%Y%m%d') || '_' || lpad(lead::VARCHAR, 3, '0') || '/chunk_' || lpad(c::VARCHAR, 2, '0') AS output_dir, (4 * lead)::BIGINT AS
        expected_steps FROM t, (SELECT unnest([31, 59]) AS lead), k""",
)
def chunk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    targets = T.load(spark, sf, "region").select(F.make_date(F.col("r_regionkey") + 1995, F.lit(4), F.lit(1)).alias("target"))
    members = T.load(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).alias("sample"))
    cases = planning.build_cases(spark, targets, [31, 59], "x")
    return _long(planning.chunk_manifest(cases, members, 5, "runs/").drop("init_time"), "lead_days", "chunk", "members", "expected_steps")


@query("case_fields_limits", sql("SELECT year::BIGINT AS year, round(max(abs(observed - probability)), 6) AS worst, count(*) AS "
        "n_cells, count_if(observed = 1)::BIGINT AS n_events FROM po GROUP BY year", "po"))
def case_fields_limits(spark: SparkSession, sf: str) -> DataFrame:
    return _long(verification.error_limits(pairs(spark, sf), CASE).withColumn("worst", r6("worst")), "year")
