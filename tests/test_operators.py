"""Operators against plain computation, and the plans of the scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid import cli
from skillgrid.functions import temporal
from skillgrid.functions.geo import in_box
from skillgrid.functions.rankstats import normal_p
from skillgrid.operators import climatology, daily, planning, plots, regrid, verification
from skillgrid.plans import catalogue


def test_picked_members_are_evenly_spaced(spark, monkeypatch):
    """All totals and numbers up to 200: the steps of a plain loop in place of a session."""
    pairs = spark.range(1, 201).select(F.col("id").alias("total")).crossJoin(spark.range(1, 201).select(F.col("id").alias("most"))).where("most <= total")
    i = F.explode(F.sequence(F.lit(0), F.col("most") - 1))
    step = F.when(F.col("most") > 1, (F.col("total") - 1) / (F.col("most") - 1)).otherwise(F.lit(0.0))
    place = F.when((F.col("i") == F.col("most") - 1) & (F.col("i") > 0), F.col("total") - 1).otherwise(F.floor(F.col("i") * step))
    rows = pairs.withColumn("i", i).groupBy("total", "most").agg(F.sort_array(F.collect_set(place)).alias("x")).collect()
    want = {(t, m): sorted(set(np.linspace(0, t - 1, m).astype(int).tolist())) for t in range(1, 201) for m in range(1, t + 1)}
    assert {(r["total"], r["most"]): r["x"] for r in rows} == want
    for total, most in ((31, 12), (62, 8), (16, 12), (7, 4), (5, 9), (1, 3), (3, 1), (0, 4), (4, 0)):
        got = sorted(r["sample"] for r in planning.pick_members(spark, total, most).collect())
        assert got == sorted(set(np.linspace(0, total - 1, max(0, min(most, total))).astype(int).tolist()))


def test_columns_and_coordinates(spark):
    of = lambda *names: spark.range(1).select(*[F.lit(1).alias(n) for n in names])
    assert daily.pick_column(of("t2m", "tmp2m"), daily.TEMPERATURE, "t") == "tmp2m"
    assert daily.pick_column(of("T2M", "2t"), daily.TEMPERATURE, "t") == "T2M"
    assert daily.pick_column(of("2t", "TMP2m"), daily.TEMPERATURE, "t") == "TMP2m"
    assert daily.pick_column(of("y", "x"), daily.LATITUDE, "lat") == "y"
    with pytest.raises(KeyError, match="none, other"):
        daily.pick_column(of("none", "other"), daily.TEMPERATURE, "t")
    assert daily.pick_coordinate(daily.LONGITUDE, of("time"), ["x", "y"]) == "x"
    assert daily.pick_coordinate(daily.LONGITUDE, of("grid_xt"), ["x"]) == "grid_xt"
    assert daily.pick_coordinate(daily.LONGITUDE, of("LON")) is None


def test_boxes(spark):
    cells = spark.createDataFrame([(float(a), float(o)) for a in (-5, 0, 5) for o in (-120, -110, 0, 170, 200, 240, 250)], "lat double, lon double")
    inside = lambda box, top: sorted((r["lat"], r["lon"]) for r in cells.where(in_box(F.col("lat"), F.col("lon"), box, top)).collect())
    assert inside((0, 5, 200, 250), 250) == [(a, o) for a in (0.0, 5.0) for o in (200.0, 240.0, 250.0)]
    assert inside((0, 0, 240, 250), 180) == [(0.0, -120.0), (0.0, -110.0)]
    assert inside((0, 0, 170, 250), 180) == [(0.0, o) for o in (170.0, 200.0, 240.0, 250.0)]


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("n,m", [(1, 5), (2, 40), (300, 500), (1000, 50)])
def test_nearest_by_running_windows(spark, n, m, parts):
    rng = random.Random(n)
    grid = sorted({rng.choice([rng.uniform(-90, 90), float(rng.randint(-90, 90))]) for _ in range(n)})
    want = sorted({rng.choice([rng.uniform(-120, 120), rng.randint(-240, 240) / 2]) for _ in range(m)})
    axis = spark.createDataFrame([(x,) for x in grid] * 2, "lat double")
    got = regrid.nearest_of({"lat": axis}, spark.createDataFrame([(x,) for x in want], "lat double"), parts)
    assert {r["lat"]: r["source_lat"] for r in got.collect()} == {t: min(grid, key=lambda s: (abs(s - t), -s)) for t in want}


def test_nearest_without_values(spark):
    some, none = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "lat double"), spark.createDataFrame([], "lat double")
    assert regrid.nearest(none, some, "lat").count() == 0 and regrid.nearest(some, none, "lat").count() == 0
    assert [tuple(r) for r in regrid.nearest(some, some, "lat").collect()] == [(1.0, 1.0)]
    cells = spark.createDataFrame([(1.0, None), (2.0, float("nan")), (5.0, 7.0)], "lat double, lon double")
    values = spark.createDataFrame([(0.0, 8.0, "a"), (4.0, 8.0, "b"), (6.0, 8.0, "c")], "lat double, lon double, v string")
    assert [tuple(r) for r in regrid.to_template(values, cells).collect()] == [(5.0, 7.0, "c")]


def test_regridding_makes_no_pairs(spark, sf_dir):
    plan = catalogue.QUERIES["regrid_nearest"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_targets_use_all_tasks(spark):
    """A million targets between two values of a short axis."""
    axis = spark.range(100).selectExpr("id * 1D as lat")
    targets = spark.range(1_000_000).selectExpr("50 + id / 2000000D as lat")
    got = regrid.nearest_of({"lat": axis}, targets, 16)
    assert [tuple(r) for r in got.groupBy("source_lat").count().collect()] == [(50.0, 1_000_000)]
    dealt = targets.select(F.pmod(F.xxhash64(F.struct("lat")), F.lit(16)).alias("part")).groupBy("part").count()
    assert dealt.agg(F.max("count")).first()[0] < 1.1 * 1_000_000 / 16


def test_normal_p(spark):
    zs = [0.0, 1e-9, 0.3, -1.0, 1.96, 2.5, -4.2, 4.243, 6.0, 10.0, -25.0, 37.0, 60.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_p(F.col("z"))).collect()]
    for z, p in zip(zs, got):
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9, abs=1e-300)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "z double").select(normal_p(F.col("z"))).collect()
    assert [r[0] for r in odd] == [None, None, 0.0]


def test_long_series_are_points_with_weights(spark):
    rng = random.Random(6)
    rows = [("long", rng.randint(0, 25) / 25, float(rng.random() < 0.3)) for _ in range(3000)]
    got = verification.rank_skill(spark.createDataFrame(rows, "cell string, probability double, observed double"), ["cell"]).first()
    zero, one = (sorted(p for _, p, o in rows if o == x) for x in (0.0, 1.0))
    s = sum((a > b) - (a < b) for a in one for b in zero)
    ties = lambda xs: sum(xs.count(v) * (xs.count(v) - 1) / 2 for v in set(xs))
    n0 = 3000 * 2999 / 2
    assert got["n"] == 3000 and got["tau"] == pytest.approx(s / math.sqrt((n0 - ties([p for _, p, _ in rows])) * (n0 - ties([o for _, _, o in rows]))))


def merge_count(p, o):
    """Concordant minus discordant pairs of series without ties in p, by merging halves."""
    o = np.asarray(o)[np.argsort(p)]
    s, width = 0, 1
    while width < len(o):
        for i in range(0, len(o), 2 * width):
            left, right = o[i : i + width], o[i + width : i + 2 * width]  # both sorted
            s += int((np.searchsorted(left, right, "left") - (len(left) - np.searchsorted(left, right, "right"))).sum())
            o[i : i + 2 * width] = np.sort(o[i : i + 2 * width])
        width *= 2
    return s


def test_long_series_of_distinct_pairs(spark):
    n = 200_000
    df = spark.range(n).selectExpr("'a' as cell", "cast((id * 48271) % 2147483647 as double) as probability", "cast(pmod(xxhash64(id), 50000) + id / 10 as double) as observed")
    rows = df.toPandas()
    s = merge_count(rows["probability"].to_numpy(), rows["observed"].to_numpy())
    pairs = verification.concordance(df.selectExpr("cell", "probability as p", "observed as o", "1L as w"), ["cell"]).first()
    assert pairs["_s"] == s
    got = verification.rank_skill(df, ["cell"]).first()
    ties = rows["observed"].value_counts()
    n0, tied = n * (n - 1) / 2, float((ties * (ties - 1) / 2).sum())
    assert got["n"] == n and got["tau"] == pytest.approx(s / math.sqrt(n0 * (n0 - tied)), rel=1e-12)


def test_concordance_equals_all_pairs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(k, float(rng.randint(0, 6 + 30 * k)), float(rng.randint(0, 40 - 12 * k)), rng.randint(1, 3)) for k in (0, 1, 2) for _ in range(60)]
        rows = list({(k, p, o): (k, p, o, w) for k, p, o, w in rows}.values()) + [(3, 1.0, 1.0, 5), (None, 1.0, 2.0, 1), (None, 2.0, 1.0, 2)]
        got = {r["k"]: r["_s"] for r in verification.concordance(spark.createDataFrame(rows, "k int, p double, o double, w long"), ["k"]).collect()}
        sign = lambda x: (x > 0) - (x < 0)
        for key in (0, 1, 2, 3, None):
            own = [r for r in rows if r[0] == key]
            assert got[key] == sum(a[3] * b[3] * sign(a[1] - b[1]) * sign(a[2] - b[2]) for i, a in enumerate(own) for b in own[:i])


@pytest.mark.parametrize("few", [3, 50, 20_000])
def test_exact_quantiles_in_rounds(spark, few):
    rng = random.Random(few)
    rows = [("a", rng.gauss(0, 1)) for _ in range(700)] + [("b", float(rng.randint(0, 4))) for _ in range(300)] + [("c", 5.0)] * 200
    rows += [("d", 1.0), ("d", 2.0), ("e", None), ("f", float("nan")), ("f", 3.0), (None, 1.0), (None, -0.0), (None, 1e300), ("g", -1e-300), ("g", 1e-300)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(3)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {r["k"]: (r["threshold"], r["n_samples"]) for r in climatology.exact_quantile(df, ["k"], q, few=few).collect()}
        want = {r["k"]: (r["threshold"], r["n_samples"]) for r in climatology.threshold(df, ["k"], q).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and (got[k][0] is None if want[k][0] is None else got[k][0] == pytest.approx(want[k][0], rel=1e-12)) for k in want)
    one = climatology.exact_quantile(df, [], 0.3, few=few).collect()
    want = climatology.threshold(df.selectExpr("1 as k", "value"), ["k"], 0.3).first()
    assert len(one) == 1 and one[0]["threshold"] == pytest.approx(want["threshold"]) and one[0]["n_samples"] == want["n_samples"]
    assert climatology.exact_quantile(df.where("k = 'z'"), ["k"], 0.5).count() == 0


def test_year_steps(spark):
    years = spark.createDataFrame([(1900,), (2000,), (2001,)], "y int")
    got = {r["y"]: r["s"] for r in years.select("y", temporal.six_hour_steps(F.col("y")).alias("s")).collect()}
    assert {y: len(s) for y, s in got.items()} == {1900: 1460, 2000: 1464, 2001: 1460}
    assert spark.range(1).select(F.size(temporal.six_hour_steps(2004))).first()[0] == 1464


@pytest.mark.parametrize("name", ["case_metrics", "spearman_p_cell", "kendall_p_cell", "skill_table", "extremes_13_fields", "event_probability", "plot_limits"])
def test_scores_scan_each_table_once_and_run_no_python(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_") <= 1 and plan.count("Relation [o_") <= 1
    assert plan.count("l_extendedprice#") and "Python" not in plan and "Arrow" not in plan


def test_no_core_plan_has_python(spark, sf_dir):
    for name, query in catalogue.QUERIES.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().toString()
        assert "PythonUDF" not in plan and "ArrowEval" not in plan and "InPandas" not in plan, name


def test_window_months_hold_the_window(spark):
    targets = spark.createDataFrame([("2000-01-10",), ("2000-02-29",)], "target string").select(F.to_date("target").alias("target"))
    days = climatology.window_days(targets, 15, F.lit(1999), F.lit(2001))
    want = {(r["target"], r["date"].year, r["date"].month) for r in days.collect()}
    assert {tuple(r) for r in climatology.window_months(targets, 15, F.lit(1999), F.lit(2001)).collect()} == want


def test_saved_skill_maps(spark):
    saved = spark.createDataFrame(
        [("heat", "030d", 1.0, 350.0, 0.4, 0.01, -0.2, 0.2, 0.2, 90), ("cold", "030d", 1.0, 10.0, None, None, 0.3, None, 0.08, 10), ("cold", "060d", 1.0, 10.0, -0.1, 0.5, 0.3, 0.04, 0.1, 80)],
        "extreme string, lead string, lat double, lon double, rho double, rho_p double, tau double, tau_p double, brier double, threshold_pct int",
    )
    of = lambda metric: [(r["lon"], r["value"], r["stipple"]) for r in plots.skill_maps(saved, metric).orderBy("lon", "lead").collect()]
    assert of("rho") == [(-10.0, 0.4, False), (10.0, None, False), (10.0, None, True)]
    assert of("tau") == [(-10.0, None, True), (10.0, 0.3, False), (10.0, 0.3, False)]
    assert of("brier") == [(-10.0, 0.2, True), (10.0, 0.08, False), (10.0, 0.1, False)]


def test_repeats():
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return len(calls)

    assert cli.repeated(work, 2, 0.0) == 3
    calls.clear()
    with pytest.raises(OSError):
        cli.repeated(work, 1, 0.0)
