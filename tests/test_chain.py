"""Sources, sinks, the command line and the streaming form."""

import json
from dataclasses import replace
from functools import reduce
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid import cli
from skillgrid.functions import temporal
from skillgrid.operators import daily, lag, planning, plots
from skillgrid.sources import arrays, readers, sinks, synthetic
from skillgrid.streaming.daily import daily_extremes


def test_sanity_chain(spark):
    row = cli.sanity(spark).first()
    assert row["n_cells"] == 64 and row["frac_obs_extreme"] == 1.0 and row["mean_pred_prob"] > 0.95
    assert row["brier_skill_score"] is None and row["spatial_corr_prob_obs"] is None and abs(row["pred_tmax_bias_C"]) < 4


def test_wrong_member_count_is_an_error(spark):
    with pytest.raises(ValueError):
        cli.forecast_daily(synthetic.forecast(spark, 2), "2014-03-30T00:00:00", members=4, steps=8)


def test_postprocess(spark, tmp_path):
    init = "2014-03-30T00:00:00"
    raw = synthetic.forecast(spark, 2)
    raw.write.parquet(f"{tmp_path}/pred_20140330")
    days = "select explode(sequence(timestamp_ntz'{0}-03-15 00:00:00', timestamp_ntz'{0}-04-17 18:00:00', interval 6 hours)) as ts"
    hours = spark.sql(days.format(2012)).union(spark.sql(days.format(2013))).union(spark.sql(days.format(2014)))
    cells = synthetic.cells(spark).select("lat", "lon", "y")
    analysis = hours.crossJoin(cells).select("ts", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (295 + 3 * F.col("y") + F.hour("ts") / 10 + F.dayofmonth("ts") / 40).alias("t2m"))
    analysis.write.parquet(f"{tmp_path}/analysis")
    cfg = readers.Config.from_mapping(
        {"output_root": "out", "target_dates": ["2014-04-01"], "lead_days": [2], "bbox": [35, 37, 250, 252], "expected_members": 3, "baseline_start_year": 2012, "analysis": f"{tmp_path}/analysis", "prediction_pattern": "pred_{init_yyyymmdd}"},
        Path(tmp_path),
    )
    rows = cli.postprocess(spark, cfg)
    assert len(rows) == 1 and rows[0]["target_date"] == "2014-04-01" and 0 <= rows[0]["brier_score"] <= 1
    assert json.loads(Path(tmp_path, "out/metrics/summary.json").read_text())["cases"] == 1
    fields = spark.read.parquet(f"{tmp_path}/out/processed/extremes")
    assert fields.count() == 64 * 3
    picked = spark.createDataFrame([(0,), (2,)], "sample int")
    assert plots.member_maps(fields, picked, ["lat", "lon"]).count() == 64 * 2
    assert plots.mean_event(fields).where("ensemble_mean_event not in (0, 1)").count() == 0
    # figure tables, metrics and index are there; another run recomputes nothing
    table = lambda name: spark.read.parquet(f"{tmp_path}/out/figures/{name}")
    assert table("event_panels").count() == table("summary_panels").count() == table("temperature_panels").count() == 64 * 4
    assert table("member_maps").count() == 64 * 3
    assert Path(tmp_path, "out/metrics/lead_comparison_metrics.csv").read_text().startswith("target_date,lead_days,init_date,")
    assert "event_panels" in Path(tmp_path, "out/figures/index.html").read_text()
    stamp = lambda: {p: p.stat().st_mtime_ns for p in Path(tmp_path, "out/processed").rglob("*.parquet")} | {p: p.stat().st_mtime_ns for p in Path(tmp_path, "out/cache").rglob("*.parquet")}
    before = stamp()
    assert cli.postprocess(spark, cfg) == rows and stamp() == before
    assert cli.postprocess(spark, cfg, cli.Options(dry_run=True)) == [] and stamp() == before
    assert cli.postprocess(spark, cfg, cli.Options(force=True)) == rows and not stamp().keys() & before.keys()
    saved = stamp()
    assert len(cli.figures(spark, cfg)) == 5 and stamp() == saved
    # some members and targets, and cases that fail
    fields = lambda: spark.read.parquet(f"{tmp_path}/out/processed/extremes")
    few = cli.postprocess(spark, cfg, cli.Options(members=(0, 2)))
    assert len(few) == 1 and fields().count() == 64 * 2
    # what was made of other settings or inputs is made again
    assert cli.postprocess(spark, cfg) == rows and fields().count() == 64 * 3
    small = replace(cfg, bbox=(35, 36, 250, 252))
    cli.postprocess(spark, small)
    assert fields().count() == 32 * 3
    later = replace(cfg, baseline_start_year=2013)
    made = stamp().keys()
    cli.postprocess(spark, later)
    assert fields().count() == 64 * 3 and any("climate_0401_2013_2013" in str(p) for p in stamp().keys() - made)
    assert cli.postprocess(spark, cfg) == rows
    assert cli.postprocess(spark, cfg, cli.Options(targets=("1999-01-01",))) == []
    worse = replace(cfg, lead_days=[2, 5])
    with pytest.raises(FileNotFoundError):
        cli.postprocess(spark, worse)
    assert len(cli.postprocess(spark, worse, cli.Options(tolerate=True))) == 1
    told = json.loads(Path(tmp_path, "out/metrics/summary.json").read_text())
    assert told["n_cases"] == 2 and told["n_done"] == 1 and list(told["failed"]) == ["2014-04-01 5"]


# Steps of six hours from the start, as files write them.
AXES = {
    "microseconds": (np.arange(1, 9) * 21600e6, {"units": "microseconds"}),
    "hours": (np.arange(1, 9) * 6.0, {"units": "hours"}),
    "days": (np.arange(1, 9) / 4, {"units": "days"}),
    "since": (np.arange(1, 9) * 6.0 + 24, {"units": "hours since 2014-02-28T00:00:00"}),
    "place": (np.arange(8.0), {}),
    "odd": (np.arange(8.0) * 6 + 6, {}),
}


@pytest.mark.parametrize("axis", AXES)
def test_time_axes_of_files(spark, tmp_path, axis):
    """Whatever its axis is written in, a file of eight steps from the first of March has the
    same days."""
    times, told = AXES[axis]
    lat, lon = np.array([35.0, 36.0]), np.array([250.0, 251.0])
    values = np.arange(8, dtype=np.float32)[None, :, None, None] + np.zeros((2, 8, 2, 2), np.float32) + 290
    at = {"sample": (("sample",), np.arange(2.0)), "time": (("time",), times), "lat": (("lat",), lat), "lon": (("lon",), lon)}
    path = Path(tmp_path, "f.nc")
    path.write_bytes(arrays.encode_netcdf(at | {"TMP2m": (("sample", "time", "lat", "lon"), values)}, {"time": told, "TMP2m": {"units": "K"}}, {}))
    raw = readers.read_grid(spark, str(path), "TMP2m", "netcdf", box=(35, 36, 250, 250.5))
    got = {(str(r["date"]), round(r["value"], 2)) for r in cli.forecast_daily(raw, "2014-03-01T00:00:00", 2, 8).collect()}
    assert got == {("2014-03-01", 18.85), ("2014-03-02", 22.85), ("2014-03-03", 23.85)}
    assert raw.select("lon").distinct().count() == 1


def test_axis_branches_of_tables(spark):
    init = temporal.ntz("2014-03-01T00:00:00")
    day = lambda df: [str(r["ts"]) for r in daily.with_valid_time(df, init).orderBy("ts").collect()]
    base = spark.range(1, 4).select((F.col("id") * 6).alias("time"))
    want = ["2014-03-01 06:00:00", "2014-03-01 12:00:00", "2014-03-01 18:00:00"]
    assert day(base) == want  # no units: places
    assert day(base.withMetadata("time", {"units": "Hours after the start"})) == want
    assert day(base.select((F.col("time") * 3600 * 10**6).alias("time")).withMetadata("time", {"units": "us"})) == want
    assert day(base.select(F.make_dt_interval(hours=F.col("time").cast("int")).alias("time"))) == want
    assert day(base.select((init + F.make_dt_interval(hours=F.col("time").cast("int"))).alias("time"))) == want
    assert day(base.withMetadata("time", {"units": "hours since 2014-03-01"})) == want


def lag_files(root, years, members, leads, odd=()):
    """Members of seasons from the first of November: a warm day at the first lead in odd years."""
    lat, lon = np.array([35.0, 36.0, 37.0]), np.array([250.0, 251.0])
    steps = 4 * (max(leads) + 5)
    for year in years:
        for k in range(members):
            t = np.arange(1, steps + 1) * 21600.0 * 10**6
            hours = 6 * (k - 12) + t / 3600e6
            heat = 8.0 * (year % 2) * (np.floor(hours / 24) == leads[0]) * (k % 5 != 0)
            values = (280 + heat)[None, :, None, None] + np.cos(hours / 24 * 2 * np.pi)[None, :, None, None] + np.zeros((1, steps, 3, 2)) + 0.001 * k
            at = {"sample": (("sample",), np.zeros(1)), "time": (("time",), t), "lat": (("lat",), lat), "lon": (("lon",), lon)}
            name = Path(root, str(year), f"member_{k:02d}", "out.nc")
            name.parent.mkdir(parents=True, exist_ok=True)
            name.write_bytes(arrays.encode_netcdf(at | {"TMP2m": (("sample", "time", "lat", "lon"), values.astype(np.float32))}, {"time": {"units": "microseconds"}}, {}))


def test_skill_command(spark, tmp_path, capsys):
    years, leads = list(range(2001, 2007)), {"003d": 3, "040d": 40}
    lag_files(f"{tmp_path}/runs", years, 25, list(leads.values()))
    Path(tmp_path, "runs/2004/member_07/out.nc").write_bytes(Path(tmp_path, "runs/2004/member_07/out.nc").read_bytes()[:-300])
    Path(tmp_path, "runs/2006/member_24/out.nc").unlink()
    days = "select explode(sequence(timestamp_ntz'{0}-10-30 00:00:00', timestamp_ntz'{0}-12-31 18:00:00', interval 6 hours)) as ts"
    hours = reduce(DataFrame.union, [spark.sql(days.format(y)) for y in range(1999, 2007)])
    cells = spark.createDataFrame([(35.0 + i, 250.0 + j) for i in range(3) for j in range(2)], "latitude double, longitude double")
    warm = F.when((F.month("ts") == 11) & (F.dayofmonth("ts") == 4) & (F.year("ts") % 2 == 1) & (F.col("latitude") < 37), 9.0).otherwise(0.0)
    value = 280 + warm + F.hour("ts") / 24 + F.dayofmonth("ts") / 60
    hours.crossJoin(cells).select("ts", "latitude", "longitude", value.alias("t2m")).write.parquet(f"{tmp_path}/analysis")
    raw = {
        "output_root": "out", "target_dates": [], "lead_days": [], "bbox": [35, 37, 250, 251], "expected_members": 25, "baseline_start_year": 1999, "analysis": f"{tmp_path}/analysis", "prediction_pattern": "x",
        "skill": {"files": f"{tmp_path}/runs/*/member_*/out.nc", "years": years, "leads": leads, "baseline": [1999, 2006]},
    }
    cfg = readers.Config.from_mapping(raw, Path(tmp_path))
    out = cli.skill(spark, cfg)
    assert "year 2004 is left out: 24 of 25 members, 1 files failed" in capsys.readouterr().err
    rows = {(r["extreme"], r["lead"], r["lat"], r["lon"]): r for r in out.collect()}
    assert len(rows) == 2 * 2 * 6 and {r["n"] for r in rows.values()} == {r["n_samples"] for r in rows.values()} == {4}
    # plain: a fifth of the members misses the warm day of odd years; the analysis has it south of 37
    for (extreme, lead, lat, _), r in rows.items():
        p = [0.8 * (y % 2) if (extreme, lead) == ("heat", "003d") else None for y in (2001, 2002, 2003, 2005)]
        if (extreme, lead) == ("heat", "003d"):
            o = [float(y % 2 and lat < 37) for y in (2001, 2002, 2003, 2005)]
            assert r["brier"] == pytest.approx(sum((a - b) ** 2 for a, b in zip(p, o)) / 4)
            assert (r["rho"] == pytest.approx(1.0) and r["tau"] == pytest.approx(1.0)) if lat < 37 else r["rho"] is None
    assert {(r["extreme"], r["threshold_pct"]) for r in rows.values()} == {("heat", 90), ("cold", 10)}
    assert set(cli.figures(spark, cfg)) == {f"{tmp_path}/out/figures/skill_{m}" for m in ("rho", "tau", "brier")}
    assert Path(tmp_path, "out/figures/skill_tau/extreme=cold/lead=040d").is_dir()
    # nothing is read again, but a repaired file and its year are
    stamp = lambda: {p: p.stat().st_mtime_ns for p in Path(tmp_path, "out/processed/snapshots").rglob("*.parquet")} | {p: p.stat().st_mtime_ns for p in Path(tmp_path, "out/cache").rglob("*.parquet")}
    before = stamp()
    assert cli.skill(spark, cfg, cli.Options(years=(2001, 2002, 2003))).select("n").distinct().collect()[0]["n"] == 3 and stamp() == before
    lag_files(f"{tmp_path}/runs", [2004], 25, list(leads.values()))
    assert {r["n"] for r in cli.skill(spark, cfg).collect()} == {5}
    changed = {p for p, t in stamp().items() if before.get(p) != t}
    assert changed and all("year=2004" in str(p) for p in changed if "snapshots" in str(p))
    with pytest.raises(ValueError, match="2 of 2"):
        cli.skill(spark, cfg, cli.Options(years=(2001, 2002)))


def test_skill_reads_each_input_once(spark):
    snaps = spark.createDataFrame([(2001, 0, 3, "a", 1.0, 0.0)], "year int, sample int, lead_days int, cell string, high double, low double")
    days = spark.createDataFrame([("a", 1.0, 0.0)], "cell string, high double, low double").withColumn("date", F.lit("2001-11-04").cast("date"))
    climate = lag.climate_and_observed(days, {"x": 3, "y": 9}, {"x": 11, "y": 11}, [2001], (2000, 2005), ["cell"])
    plan = climate._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    pairs = lag.verification_pairs(snaps, climate, ["cell"])
    assert pairs.count() == 2


def test_only_months_that_are_asked_for_are_read(spark, tmp_path):
    days = "select explode(sequence(timestamp_ntz'{0}-01-01 00:00:00', timestamp_ntz'{0}-12-31 18:00:00', interval 6 hours)) as ts"
    hours = spark.sql(days.format(2012)).union(spark.sql(days.format(2013)))
    cells = synthetic.cells(spark).select("lat", "lon")
    hours.crossJoin(cells.limit(3)).select("ts", "lat", "lon", F.lit(280.0).alias("t2m")).write.parquet(f"{tmp_path}/a")
    base = {"output_root": "o", "target_dates": [], "lead_days": [], "bbox": [35, 37, 250, 252], "expected_members": 1, "baseline_start_year": 2012, "analysis": f"{tmp_path}/a", "prediction_pattern": "x"}
    analysis = cli.Analysis(spark, readers.Config.from_mapping(base, tmp_path), f"{tmp_path}/cache")
    months = lambda *m: spark.createDataFrame(list(m), "year int, month int")
    name, seen = analysis.on_grid(cells.limit(3), months((2012, 2), (2012, 3), (2013, 2)))
    assert seen.count() == 3 * (29 + 31 + 28)
    folders = lambda: sorted(str(p.relative_to(f"{name}/daily")) for p in Path(name, "daily").glob("year=*/month=*"))
    assert folders() == ["year=2012/month=2", "year=2012/month=3", "year=2013/month=2"]
    _, seen = analysis.on_grid(cells.limit(3), months((2013, 2), (2013, 3)))
    assert seen.count() == 3 * (28 + 31) and len(folders()) == 4
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "201302,201303" in plan.split("PartitionFilters: [")[1].split("], ")[0]


def test_run_configs(spark, tmp_path):
    cases = planning.build_cases(spark, ["2014-04-01"], [31], "x")
    manifest = [r.asDict() for r in planning.chunk_manifest(cases, 7, 5, f"{tmp_path}/raw").orderBy("chunk").collect()]
    names = sinks.write_run_configs(manifest, f"{tmp_path}/configs", {"checkpoint_path": "m.ckpt", "initial_condition": {"path": "ic.nc"}})
    got = [json.loads(Path(n).read_text()) for n in names]
    assert [g["n_ensemble_per_ic"] for g in got] == [5, 2] and {g["n_forward_steps"] for g in got} == {124}
    assert got[0]["initial_condition"] == {"path": "ic.nc", "start_indices": {"times": ["2014-03-01T00:00:00"]}} and got[0]["checkpoint_path"] == "m.ckpt"
    assert names[1].endswith("2014-04-01_031/chunk001.yaml")


def test_plan_writes_chunks_and_their_configurations(spark, tmp_path):
    raw = {
        "output_root": "out", "target_dates": ["2014-04-01", "2015-04-01"], "lead_days": [31], "bbox": [0, 1, 2, 3], "expected_members": 7, "baseline_start_year": 1990, "analysis": "a",
        "prediction_pattern": "p_{lead:03d}", "model": {"members_per_chunk": 3, "settings": {"checkpoint_path": "m.ckpt"}},
    }
    cfg = readers.Config.from_mapping(raw, Path(tmp_path))
    cli.plan(spark, cfg, cli.Options(dry_run=True))
    assert not Path(tmp_path, "out").exists()
    cli.plan(spark, cfg)
    chunks = spark.read.csv(f"{tmp_path}/out/plans/chunks", header=True).collect()
    assert [(r["target_date"], r["chunk"], r["members"]) for r in chunks] == [(d, str(c), m) for d in raw["target_dates"] for c, m in ((0, "3"), (1, "3"), (2, "1"))]
    one = json.loads(Path(tmp_path, "out/plans/configs/2015-04-01_031/chunk002.yaml").read_text())
    assert one["n_ensemble_per_ic"] == 1 and one["n_forward_steps"] == 124 and one["checkpoint_path"] == "m.ckpt"
    assert one["experiment_dir"] == f"{tmp_path}/out/runs/20150401_031/chunk_02" and one["initial_condition"]["start_indices"] == {"times": ["2015-03-01T00:00:00"]}


def test_configuration(tmp_path):
    with pytest.raises(KeyError, match="lead_days"):
        readers.Config.from_mapping({"output_root": "x"}, tmp_path)
    base = {"output_root": "o", "target_dates": ["2014-04-01"], "lead_days": [31], "bbox": [0, 1, 2, 3], "expected_members": 1, "baseline_start_year": 1990, "reanalysis_zarr": "gs://b/x", "prediction_pattern": "/abs/{lead}"}
    cfg = readers.Config.from_mapping(base, tmp_path)
    assert cfg.output_root == f"{tmp_path}/o" and cfg.analysis == "gs://b/x" and cfg.prediction_pattern == "/abs/{lead}" and cfg.last_baseline_year(2014) == 2013 and cfg.max_map_members == 6
    at = tmp_path / "configs" / "a.json"
    at.parent.mkdir()
    at.write_text(json.dumps(base))
    assert readers.Config.read(at) == cfg


def test_rounding_is_half_even_on_the_binary_value():
    assert sinks.python_round(2.675, 2) == 2.67 and sinks.python_round(0.125, 2) == 0.12 and sinks.python_round(None, 2) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, p string, v double")
    sinks.write_table(df, f"{tmp_path}/t", ["p"])
    sinks.write_table(df.where("p = 'b'").withColumn("v", F.lit(9.0)), f"{tmp_path}/t", ["p"], keep_others=True)
    assert sorted((r["p"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 1.0), ("b", 9.0)]
    sinks.write_skill(df.select("k", "v"), f"{tmp_path}/s", "heat", "030d", n_years=7)
    sinks.write_skill(df.select("k", "v"), f"{tmp_path}/s", "cold", "030d", n_years=7)
    assert spark.read.parquet(f"{tmp_path}/s").where("n_years = 7").count() == 4
    sinks.write_csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2
    sinks.write_index(str(tmp_path), [f"{tmp_path}/b.png", f"{tmp_path}/a.png", f"{tmp_path}/a.png"])
    page = Path(tmp_path, "index.html").read_text()
    assert page.count("<img") == 2 and page.index("a.png") < page.index("b.png")
    with pytest.raises(FileNotFoundError, match="nowhere"):
        readers.require(spark, [f"{tmp_path}/t", f"{tmp_path}/nowhere"])


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("cell"), "ts", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = daily_extremes(stream, ["cell"], late="60 days").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", f"{tmp_path}/state").start()
    out.processAllAvailable()
    out.stop()
    want = daily.daily_range(events, ["cell"])
    got = spark.table("days")
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0
