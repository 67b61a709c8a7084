"""The places where array and SQL semantics part."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skillgrid.functions import geo, nulls, temporal
from skillgrid.operators import climatology, daily, extremes, planning, regrid, verification

NAN = float("nan")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_comparison_with_nan_is_false(spark):
    x, y = F.lit(NAN), F.lit(1.0)
    got = one(spark, a=nulls.exceeds(x, y), b=nulls.exceeds(y, x), c=nulls.falls_below(x, y), d=nulls.exceeds(F.lit(None).cast("double"), y), e=nulls.exceeds(F.lit(2.0), y))
    assert got == {"a": False, "b": False, "c": False, "d": False, "e": True}


def test_finite_excludes_infinities(spark):
    got = one(spark, a=nulls.finite(F.lit(1.0), F.lit(math.inf)), b=nulls.finite(F.lit(1.0)), c=nulls.finite(F.lit(NAN)), d=nulls.finite(F.lit(None).cast("double")))
    assert got == {"a": False, "b": True, "c": False, "d": False}


def test_missing_members_count_in_the_denominator(spark):
    fc = spark.createDataFrame([(0, 0, 0, 5.0), (0, 0, 1, NAN), (0, 0, 2, 0.0), (0, 0, 3, 7.0)], "cell int, year int, sample int, value double")
    limit = spark.createDataFrame([(0, 1.0)], "cell int, threshold double")
    got = extremes.event_probability(fc, limit, ["cell"], ["year"]).first()
    assert got["probability"] == 0.5 and got["n_members"] == 4 and got["spread"] == pytest.approx(0.5)


def test_aggregates_skip_nan(spark):
    rows = spark.createDataFrame([("a", NAN), ("a", 1.0), ("a", 3.0)], "cell string, value double")
    assert climatology.mean_of(rows, ["cell"]).first()["baseline"] == 2.0
    got = climatology.threshold(rows, ["cell"], 0.5).first()
    assert got["threshold"] == 2.0 and got["n_samples"] == 2


def test_daily_extreme_of_missing_day_is_null(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 6), NAN), (1, datetime(2024, 1, 2, 6), 4.0)], "cell int, ts timestamp_ntz, value double")
    got = {r["date"]: (r["value"], r["n"]) for r in daily.daily_extreme(rows, ["cell"]).collect()}
    assert got == {date(2024, 1, 1): (None, 0), date(2024, 1, 2): (4.0, 1)}


def test_units_are_decided_for_the_table(spark):
    kelvin = spark.createDataFrame([(300.0,), (50.0,)], "v double")
    assert [round(r["v"], 2) for r in daily.to_celsius(kelvin, "v").orderBy("v").collect()] == [-223.15, 26.85]
    celsius = spark.createDataFrame([(99.0,), (101.0,), (NAN,)], "v double")
    assert sorted(r["v"] for r in daily.to_celsius(celsius, "v").where("v is not null").collect()) == [99.0, 101.0]


def test_absent_day_is_an_error(spark):
    rows = spark.createDataFrame([(date(2024, 1, 1), 1.0)], "date date, value double")
    assert daily.on_date(rows, "2024-01-01").count() == 1
    with pytest.raises(KeyError):
        daily.on_date(rows, "2024-01-02")


def test_steps_and_calendar(spark):
    init = temporal.ntz("2014-03-01T00:00:00")
    got = one(
        spark, last=temporal.valid_time(init, position=F.lit(123)), lag=temporal.lag_init(init, F.lit(0)), centre=temporal.lag_init(init, F.lit(12)),
        leap=temporal.same_day(F.lit(2023), F.lit(2), F.lit(29)), real=temporal.same_day(F.lit(2024), F.lit(2), F.lit(29)), late=temporal.target_date(F.lit(1999), F.lit(90)),
        before=temporal.epoch_index(temporal.ntz("1939-12-31T00:00:00")), under=temporal.epoch_index(temporal.ntz("1940-01-01T11:00:00"), clamp=False),
        cf=temporal.cf_time(F.lit(30.0), "hours since 1940-01-01T12:00:00"), micros=temporal.valid_time(init, F.lit(3600 * 10**6), "microseconds"),
        year=F.size(temporal.six_hour_steps(2024)),
    )
    assert got == {
        "last": datetime(2014, 4, 1), "lag": datetime(2014, 2, 26), "centre": datetime(2014, 3, 1), "leap": date(2023, 2, 28), "real": date(2024, 2, 29),
        "late": date(2000, 1, 30), "before": 0, "under": -1, "cf": datetime(1940, 1, 2, 18), "micros": datetime(2014, 3, 1, 1), "year": 366 * 4,
    }
    with pytest.raises(ValueError):
        temporal.valid_time(init, F.lit(1), "fortnights")


def test_window_crosses_new_year_and_repeats_rows_for_each_target(spark):
    days = spark.sql("select explode(sequence(date'1999-12-01', date'2000-01-31')) as date").withColumn("cell", F.lit(1)).withColumn("value", F.dayofyear("date").cast("double"))
    targets = spark.createDataFrame([("2005-01-01",)], "t string").select(F.to_date("t").alias("target"))
    got = climatology.window_climatology(days, targets, ["cell"], 15, F.lit(2000), F.lit(2000), 0.9).first()
    assert got["n_samples"] == 31


def test_box_wraps_only_east_of_180(spark):
    rows = spark.createDataFrame([(40.0, -100.0), (40.0, 100.0)], "lat double, lon double")
    assert rows.where(geo.in_box(F.col("lat"), F.col("lon"), (18, 72, 195, 305), 180)).count() == 1
    assert rows.where(geo.in_box(F.col("lat"), F.col("lon"), (18, 72, 0, 360), 180)).count() == 1


def test_nearest_tie_takes_the_larger(spark):
    src = spark.createDataFrame([(0.0, 0.0, 1), (10.0, 0.0, 2)], "lat double, lon double, v int")
    out = regrid.to_template(src, spark.createDataFrame([(5.0, 3.0), (4.0, 3.0)], "lat double, lon double"))
    assert {r["lat"]: r["v"] for r in out.collect()} == {5.0: 2, 4.0: 1}


def test_scores_of_constant_observations_are_null(spark):
    rows = spark.createDataFrame([(1, 0.2, 0.0), (1, 0.4, 0.0)], "year int, probability double, observed double")
    got = verification.case_metrics(rows, ["year"]).first()
    assert got["brier_skill_score"] is None and got["spatial_corr_prob_obs"] is None and got["brier_score"] == pytest.approx(0.1)


def test_area_mean_skips_missing(spark):
    rows = spark.createDataFrame([(0, 0.0, 1.0), (0, 60.0, NAN), (0, 60.0, 4.0), (1, 0.0, NAN)], "k int, lat double, v double")
    got = {r["k"]: r["area_mean"] for r in verification.area_mean(rows, ["k"], "v").collect()}
    assert got[0] == pytest.approx((1 + 0.5 * 4) / 1.5) and got[1] is None


def test_undefined_p_values_are_not_stippled(spark):
    rows = spark.createDataFrame([(None, 0.5, 0.2), (0.2, NAN, 0.05)], "rho_p double, tau_p double, brier double")
    got = [(r["rho_stipple"], r["tau_stipple"], r["brier_stipple"]) for r in verification.stippled(rows).collect()]
    assert got == [(False, True, True), (True, False, False)]


def test_planning(spark):
    cases = planning.build_cases(spark, ["2014-04-01"], [31, 59], "a/{target_yyyymmdd}_{init_yyyymmdd}_{lead:03d}_{horizon}").collect()
    assert [c["init_time"] for c in cases] == ["2014-03-01T00:00:00", "2014-02-01T00:00:00"]
    assert cases[0]["prediction_path"] == "a/20140401_20140301_031_31" and cases[0]["required_6hour_steps"] == 124
    assert tuple(cases[0].asDict()) == planning.CASE_COLUMNS
    assert [r["sample"] for r in planning.pick_members(spark, 25, 6).orderBy("sample").collect()] == [0, 4, 9, 14, 19, 24]
    assert [r["sample"] for r in planning.pick_members(spark, 1, 6).collect()] == [0]
    chunks = planning.member_chunks(spark.range(12).select(F.col("id").alias("sample")), 5).orderBy("chunk").collect()
    assert [c["n_members"] for c in chunks] == [5, 5, 2]


def test_column_aliases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "T2M double, latitude double, lon double")
    assert daily.pick_column(df, daily.TEMPERATURE, "temperature") == "T2M" and daily.pick_column(df, daily.LATITUDE, "latitude") == "latitude"
    with pytest.raises(KeyError, match="latitude"):
        daily.pick_column(df.drop("latitude"), daily.LATITUDE, "latitude")


def test_attributes_and_replication(spark):
    from skillgrid.operators import forcing

    df = spark.createDataFrame([("ak_0", 5.0), ("other", 7.0)], "name string, value double")
    out = forcing.describe(forcing.describe(df, "value", units="Pa"), "value", units="K", long_name="v")
    assert out.schema["value"].metadata == {"units": "Pa", "long_name": "v"}
    assert [r["value"] for r in forcing.substitute(df, {"ak_0": 1.0}).orderBy("name").collect()] == [1.0, 7.0]
    assert forcing.replicate(df, 3).count() == 6 and forcing.replicate(forcing.replicate(df, 3), 9).count() == 6
