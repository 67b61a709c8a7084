"""plan, postprocess, skill, figures and sanity from the command line."""

from __future__ import annotations

import argparse
import hashlib
import json
import re
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import temporal
from .operators import climatology, daily, extremes, forcing, lag, planning, plots, regrid, verification
from .session import build_session
from .sources import arrays, readers, sinks, synthetic

METRICS = ("frac_obs_extreme", "mean_pred_prob", "brier_score", "brier_skill_score", "spatial_corr_prob_obs")
DIGITS = dict.fromkeys(METRICS, 4) | {"pred_tmax_bias_C": 3, "pred_tmax_rmse_C": 3}
CELL, CASE = ["lat", "lon"], ["target_date", "lead_days"]
HALF_DAYS = 15
#: Years that rank statistics need.
LEAST_YEARS = 3
#: Seconds to wait before the k-th repeat of a case, times k.
WAIT = 30.0

T = TypeVar("T")


@dataclass(frozen=True)
class Options:
    """How a run treats what is there already, and what fails.

    force computes cases whose fields are there, force_figures only their figure tables;
    dry_run prints the cases and what would be done with them. retries repeats a failing
    case, with growing waits; tolerate goes on after one that still fails, which then counts
    in the summary. targets, members and years choose some of the configured ones."""

    force: bool = False
    force_figures: bool = False
    dry_run: bool = False
    tolerate: bool = False
    retries: int = 0
    wait: float = WAIT
    targets: tuple[str, ...] = ()
    members: tuple[int, ...] = ()
    years: tuple[int, ...] = ()


def time_axis(raw: DataFrame) -> str:
    """The column of the time axis: times, offsets or steps."""
    return next(c for c in (*readers.TIMES, "step") if c in raw.columns)


def forecast_daily(raw: DataFrame, init: str, members: int = 0, steps: int = 0) -> DataFrame:
    """sample, lat, lon, date, value (°C): daily maxima of a forecast with sample and a time
    axis. One pass beforehand counts members and steps and looks at the first field: a mean
    of over 100 tells Kelvin."""
    value, time = daily.pick_column(raw, daily.TEMPERATURE, "temperature"), time_axis(raw)
    fields = raw.groupBy("sample", time).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    told = fields.agg(F.count_distinct("sample").alias("members"), F.count_distinct(time).alias("steps"), F.min_by("mean", F.struct("sample", time)).alias("mean")).first()
    if members and told["members"] != members or told["steps"] < steps:
        raise ValueError(f"expected {members} members and {steps} steps, found {told['members']} and {told['steps']}")
    rows = daily.with_valid_time(raw, temporal.ntz(init), time, "_valid")
    x = F.col(value).cast("double")
    rows = rows.select("sample", *CELL, F.col("_valid").alias("ts"), (daily.celsius(x) if (told["mean"] or 0) > 100 else x).alias("value"))
    return daily.daily_extreme(rows, ["sample", *CELL])


def case_fields(pred: DataFrame, obs: DataFrame, climate: DataFrame, target: str) -> DataFrame:
    """The 13 fields of a target date."""
    day = daily.on_date(pred, target).select("sample", *CELL, "value", F.lit(target).alias("target_date"))
    seen = obs.select(*CELL, "value", F.lit(target).alias("target_date"))
    return extremes.extremes_fields(day, seen, climate, climate, CELL, ["target_date"])


def case_scores(fields: DataFrame) -> DataFrame:
    one = fields.groupBy("target_date", *CELL).agg(*[F.min_by(c, "sample").alias(c) for c in extremes.FIELDS])
    one = one.withColumn("probability", F.col("predicted_hot_extreme_probability")).withColumn("observed", F.col("observed_hot_extreme"))
    return verification.case_metrics(one, ["target_date"], forecast="predicted_daily_tmax_C_ensmean", truth="observed_daily_tmax_C")


def sanity(spark: SparkSession, target: str = "2014-04-01", lead_days: int = 31) -> DataFrame:
    """The chain on analytic inputs."""
    init = planning.build_cases(spark, [target], [lead_days], "x").first()["init_time"]
    obs = synthetic.observation(spark)
    pred = forecast_daily(synthetic.forecast(spark, lead_days), init, 3, 4 * lead_days)
    return case_scores(case_fields(pred, obs, synthetic.climate(obs), target))


def repeated(work: Callable[[], T], retries: int, wait: float) -> T:
    """The result of `work`, tried again after growing waits if it fails."""
    for k in range(1, retries + 1):
        try:
            return work()
        except Exception as failure:
            print(f"attempt {k} of {retries + 1} failed: {failure}", file=sys.stderr)
            time.sleep(wait * k)
    return work()


def write_figures(fields: DataFrame, folder: str, lead_days: int, most_members: int) -> list[str]:
    """The figure tables of a case, each a partition of one table for all cases."""
    spark, keys = fields.sparkSession, ["target_date", *CELL]
    picked = planning.pick_of(fields.agg(F.count_distinct("sample").alias("total")), most_members)
    tables = {
        "event_panels": plots.panels(fields, keys, plots.EVENT_PANELS),
        "summary_panels": plots.panels(fields, keys, plots.SUMMARY_PANELS),
        "temperature_panels": plots.temperature_panels(fields, keys, ["target_date"]),
        "mean_event": plots.mean_event(fields).groupBy(*keys).agg(*[F.min_by(c, "sample").alias(c) for c in ("ensemble_mean_event", "observed_hot_extreme")]),
        "member_maps": plots.member_maps(fields, picked, keys),
    }
    for name, table in tables.items():
        sinks.write_table(table.withColumn("lead_days", F.lit(lead_days)), f"{folder}/{name}", CASE, keep_others=True)
    return [f"{folder}/{name}" for name in tables]


class Analysis:
    """Daily extremes of the analysis on a forecast's grid, and its climate. Days are a table
    with a partition for each month; months that are asked for and not there yet are read, and
    no others. What is kept is named after the input, its size and the box, so another input is
    never taken for it."""

    def __init__(self, spark: SparkSession, cfg: readers.Config, cache: str, force: bool = False) -> None:
        self.spark, self.cfg, self.force = spark, cfg, force
        self.name = digest(readers.fingerprint(spark, cfg.analysis), list(cfg.bbox))
        self.cache = f"{cache}/analysis_{self.name}"
        self.made: set[str] = set()

    def _fresh(self, path: str) -> bool:
        """Whether a table is to be made again in spite of its being there."""
        known = path in self.made
        self.made.add(path)
        return self.force and not known

    def on_grid(self, template: DataFrame, months: DataFrame) -> tuple[str, DataFrame]:
        """The name of the grid, and lat, lon, date, value (maximum), low of the months (year, month)."""
        grid = template.agg(F.count("*"), F.sum(F.xxhash64(*CELL).cast("decimal(38,0)"))).first()
        name = f"{self.cache}/grid_{grid[0]}_{int(grid[1]) % 2**32:08x}"
        path = f"{name}/daily"
        wanted = sorted((r["year"], r["month"]) for r in months.select("year", "month").distinct().collect())  # some for each year of the baseline
        of = lambda df: df.where((F.col("year") * 100 + F.col("month")).isin([100 * y + m for y, m in wanted]))
        have = set()
        if not self._fresh(path) and readers.exists(self.spark, path):
            have = {(r["year"], r["month"]) for r in of(self.spark.read.parquet(path)).select("year", "month").distinct().collect()}
        if absent := [x for x in wanted if x not in have]:
            sinks.write_table(self._days(template, absent), path, ["year", "month"], keep_others=True)
        # the filter prunes partitions: only files of these months are read
        return name, of(self.spark.read.parquet(path))

    def _days(self, template: DataFrame, months: list[tuple[int, int]]) -> DataFrame:
        """Days of the months, of which runs are read as ranges of times."""
        runs: list[list[int]] = []
        for i in (12 * y + m - 1 for y, m in months):
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        first = lambda i: f"{i // 12:04d}-{i % 12 + 1:02d}-01T00:00:00"
        before = lambda i: str(np.datetime64(first(i), "us") - np.timedelta64(1, "us"))
        path, kind = self.cfg.analysis, readers.format_of(self.cfg.analysis)
        rows = readers.read_grid(self.spark, path, format=kind, box=self.cfg.bbox, times=[(first(a), before(b + 1)) for a, b in runs])
        rows = rows.withColumnRenamed(time_axis(rows), "ts")
        axes = readers.axes(self.spark, path, kind, self.cfg.bbox)
        found = daily.daily_range(daily.to_celsius(regrid.to_template(rows.select(*CELL, "ts", "value"), template, axes=axes), "value"), CELL)
        found = found.select(*CELL, "date", F.col("max_value").alias("value"), F.col("min_value").alias("low"), F.year("date").alias("year"), F.month("date").alias("month"))
        wanted = self.spark.createDataFrame(months, "year int, month int")
        return found.join(F.broadcast(wanted), ["year", "month"], "left_semi")

    def climate(self, grid: str, seen: DataFrame, target: str) -> DataFrame:
        first, last = self.baseline(target)
        path = f"{grid}/climate_{target[5:7]}{target[8:]}_{first}_{last}"
        if self._fresh(path) or not readers.exists(self.spark, f"{path}/_SUCCESS"):
            sinks.write_table(climatology.window_climatology(seen, self._day(target), CELL, HALF_DAYS, F.lit(first), F.lit(last), 0.9), path)
        return self.spark.read.parquet(path)

    def baseline(self, target: str) -> tuple[int, int]:
        return self.cfg.baseline_start_year, self.cfg.last_baseline_year(int(target[:4]))

    def _day(self, target: str) -> DataFrame:
        return self.spark.createDataFrame([(target,)], "target string").select(F.to_date("target").alias("target"))

    def months(self, target: str) -> DataFrame:
        """year, month of the climate's windows, and of the target itself."""
        first, last = self.baseline(target)
        window = climatology.window_months(self._day(target), HALF_DAYS, F.lit(first), F.lit(last)).select("year", "month")
        return window.unionByName(self._day(target).select(F.year("target").alias("year"), F.month("target").alias("month"))).distinct()


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()[:16]


class Ledger:
    """What is finished, and from which settings and inputs: a table with a partition for
    each piece of work. Work whose digest differs is not done."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(path).select("work", "digest").collect() if readers.exists(spark, path) else []
        self.held = {r["work"]: r["digest"] for r in rows}

    def done(self, work: str, want: str) -> bool:
        return self.held.get(work) == want

    def finish(self, work: str, want: str) -> None:
        self.held[work] = want
        row = self.spark.createDataFrame([(work, want)], "work string, digest string").coalesce(1)
        sinks.write_table(row, self.path, ["work"], keep_others=True)


def plan(spark: SparkSession, cfg: readers.Config, options: Options = Options()) -> DataFrame:
    """The cases, printed and (unless dry) written. With `model` settings also the chunks of
    members in which the model runs (members_per_chunk), and a configuration for each, of
    the model's own `settings`."""
    targets = [t for t in cfg.target_dates if not options.targets or t in options.targets]
    cases, folder = planning.build_cases(spark, targets, cfg.lead_days, cfg.prediction_pattern), sinks.layout(cfg.output_root)["plans"]
    if not options.dry_run:
        sinks.write_csv(cases, f"{folder}/cases")
        if cfg.model:
            chunks = planning.chunk_manifest(cases, cfg.expected_members, int(cfg.model.get("members_per_chunk", 5)), f"{cfg.output_root}/runs")
            sinks.write_csv(chunks.orderBy("target_date", "lead_days", "chunk"), f"{folder}/chunks")
            sinks.write_run_configs([r.asDict() for r in chunks.collect()], f"{folder}/configs", cfg.model.get("settings", {}))
    cases.show(1000, truncate=False)
    return cases


def run_case(spark: SparkSession, cfg: readers.Config, row: dict, analysis: Analysis, ledger: Ledger, paths: dict[str, str], options: Options) -> list[dict]:
    """Fields, figure tables and scores of one case. Fields are read again if they were made
    of the same inputs with the same members, box and baseline."""
    target, lead = row["target_date"], row["lead_days"]
    table = f"{paths['processed']}/extremes"
    part = f"{table}/target_date={target}/lead_days={lead}"
    readers.require(spark, [row["prediction_path"]])
    settings = [options.members, cfg.expected_members, list(cfg.bbox), analysis.baseline(target), HALF_DAYS, analysis.name]
    work, want = f"case_{target}_{lead}", digest(readers.fingerprint(spark, row["prediction_path"]), row["init_time"], *settings)
    there = ledger.done(work, want) and readers.exists(spark, part)
    if options.force or not there:
        raw = readers.read_grid(spark, row["prediction_path"], "TMP2m", readers.format_of(row["prediction_path"]), box=cfg.bbox)
        members = cfg.expected_members
        if options.members:
            raw, members = raw.where(F.col("sample").isin(*options.members)), len(options.members)
        pred = forecast_daily(raw, row["init_time"], members, row["required_6hour_steps"])
        grid, seen = analysis.on_grid(raw.select(*CELL).distinct(), analysis.months(target))
        fields = case_fields(pred, daily.on_date(seen, target), analysis.climate(grid, seen, target), target)
        sinks.write_table(fields.withColumn("lead_days", F.lit(lead)), table, CASE, keep_others=True)
        ledger.finish(work, want)
    fields = spark.read.parquet(part).withColumn("target_date", F.lit(target))
    drawn = digest(want, cfg.max_map_members)
    if options.force or options.force_figures or not there or not ledger.done(f"figures_{work}", drawn):
        write_figures(fields, paths["figures"], lead, cfg.max_map_members)
        ledger.finish(f"figures_{work}", drawn)
    scores = sinks.report_metrics(case_scores(fields), DIGITS)
    return [{"target_date": s.pop("target_date"), "lead_days": lead, "init_date": row["init_time"][:10]} | s for s in scores]


def postprocess(spark: SparkSession, cfg: readers.Config, options: Options = Options()) -> list[dict]:
    """Scores of all cases; writes fields, figure tables, metrics, an index and a summary."""
    began, paths, out, failed = time.time(), sinks.layout(cfg.output_root), [], {}
    rows = [r.asDict() for r in plan(spark, cfg, options).collect()]
    if options.dry_run:
        return []
    if not rows:
        return []
    analysis, ledger = Analysis(spark, cfg, paths["cache"], options.force), Ledger(spark, f"{paths['processed']}/ledger")
    for row in rows:
        work = lambda row=row: run_case(spark, cfg, row, analysis, ledger, paths, options)
        try:
            out += repeated(work, options.retries, options.wait)
        except Exception as failure:
            if not options.tolerate:
                raise
            failed[f"{row['target_date']} {row['lead_days']}"] = str(failure).split("\n")[0]
    sinks.write_rows(out, f"{paths['metrics']}/lead_comparison_metrics.csv")
    sinks.write_index(paths["figures"], [], [f"{paths['figures']}/{n}" for n in ("event_panels", "summary_panels", "temperature_panels", "mean_event", "member_maps")])
    summary = {"seconds": round(time.time() - began, 3), "n_cases": len(rows), "n_done": len(rows) - len(failed), "failed": failed}
    sinks.write_json(summary | {"cases": len(out), "metrics": out}, f"{paths['metrics']}/summary.json")
    return out


def figures(spark: SparkSession, cfg: readers.Config) -> list[str]:
    """All figure tables again, from saved fields and saved skill tables alone."""
    paths, made = sinks.layout(cfg.output_root), []
    if readers.exists(spark, f"{paths['processed']}/extremes"):
        saved = spark.read.parquet(f"{paths['processed']}/extremes").withColumn("target_date", F.col("target_date").cast("string"))
        for row in saved.select(*CASE).distinct().collect():
            one = saved.where((F.col("target_date") == row["target_date"]) & (F.col("lead_days") == row["lead_days"])).drop("lead_days")
            made = write_figures(one, paths["figures"], row["lead_days"], cfg.max_map_members)
    if readers.exists(spark, f"{paths['processed']}/skill"):
        skill = readers.read_skill(spark, f"{paths['processed']}/skill")
        for metric in ("rho", "tau", "brier"):
            made.append(f"{paths['figures']}/skill_{metric}")
            sinks.write_table(plots.skill_maps(skill, metric), made[-1], ["extreme", "lead"])
    sinks.write_index(paths["figures"], [], made)
    return made


def skill(spark: SparkSession, cfg: readers.Config, options: Options = Options()) -> DataFrame:
    """Skill maps of a lagged ensemble for all leads and both extremes, as one table.

    Settings under `skill`: files (a path with *), name_pattern (groups year and sample),
    years, leads (name: days), members, baseline (first and last year). All member files are
    one source, read once into daily extremes on the target days; a file that cannot be
    read is a row of that table, and its year is left out, as is one with too few members.
    n_samples is the number of years that were used."""
    own, paths = cfg.skill, sinks.layout(cfg.output_root)
    leads, members = {str(k): int(v) for k, v in own["leads"].items()}, int(own.get("members", temporal.MEMBERS))
    years = [y for y in map(int, own["years"]) if not options.years or y in options.years]
    first, last = map(int, own.get("baseline", (cfg.baseline_start_year, cfg.baseline_end_year or max(years))))
    pattern = own.get("name_pattern", r"(?P<year>\d{4})/member_(?P<sample>\d+)")
    files = arrays.expand(own["files"])
    ledger, table = Ledger(spark, f"{paths['processed']}/ledger"), f"{paths['processed']}/snapshots"
    inputs = arrays.file_sizes(files)
    todo = []
    for year in years:
        mine = [x for x in inputs if (m := re.search(pattern, x[0])) and int(m["year"]) == year]
        work, want = f"snapshots_{year}", digest(mine, leads, list(cfg.bbox))
        if mine and (options.force or not ledger.done(work, want)):
            todo.append((year, work, want))
    if todo:
        kind = readers.format_of(files[0])
        raw = readers.read_grid(
            spark, own["files"], "value", kind, box=cfg.bbox, name_pattern=pattern, on_error="row", groups=json.dumps({"year": [[y, y] for y, _, _ in todo]}),
        )
        sinks.write_table(lag.snapshots(raw, list(leads.values()), CELL, time_axis(raw)), table, ["year"], keep_others=True)
        for _, work, want in todo:
            ledger.finish(work, want)
    snaps = spark.read.parquet(table).where(F.col("year").isin(*years))
    told = {r["year"]: r for r in lag.complete_years(snaps, members, list(leads.values())).collect()}
    used = [y for y in years if y in told and told[y]["complete"]]
    for y in sorted(set(years) - set(used)):
        print(f"year {y} is left out: {told[y]['n_members'] if y in told else 0} of {members} members, {told[y]['n_failed'] if y in told else 0} files failed", file=sys.stderr)
    if len(used) < LEAST_YEARS:
        raise ValueError(f"{len(used)} of {len(years)} years can be read, {LEAST_YEARS} are needed")
    snaps = snaps.where(F.col("year").isin(*used))
    target = lambda y, d: np.datetime64(f"{y}-{lag.MONTH:02d}-{lag.DAY:02d}") + np.timedelta64(d, "D")
    month = lambda t: (int(str(t)[:4]), int(str(t)[5:7]))
    months = {n: month(target(years[0], d))[1] for n, d in leads.items()}
    wanted = {(y, m) for m in months.values() for y in range(first, last + 1)} | {month(target(y, d)) for y in used for d in leads.values()}
    analysis = Analysis(spark, cfg, paths["cache"], options.force)
    template = snaps.where("lead_days is not null").select(*CELL).distinct()
    _, days = analysis.on_grid(template, spark.createDataFrame(sorted(wanted), "year int, month int"))
    days = days.select(*CELL, "date", F.col("value").alias("high"), "low")
    climate = lag.climate_and_observed(days, leads, months, used, (first, last), CELL)
    kelvin = snaps.withColumns({c: daily.celsius(F.col(c)) for c in ("high", "low")})
    out = lag.skill_maps(lag.verification_pairs(kelvin, climate, CELL), CELL)
    share = F.create_map(*[F.lit(x) for e, (_, _, p) in lag.EXTREMES.items() for x in (e, p)])
    out = out.withColumn("n_samples", F.lit(len(used))).withColumn("threshold_pct", share[F.col("extreme")])
    named = {"rho": "Spearman rank correlation", "tau": "Kendall tau", "brier": "Brier score"}
    for column, text in named.items():
        out = forcing.describe(out, column, long_name=text)
    path = f"{paths['processed']}/skill"
    sinks.write_table(out, path, ["extreme", "lead"], keep_others=True)
    return readers.read_skill(spark, path)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skillgrid")
    parser.add_argument("command", choices=("plan", "postprocess", "skill", "figures", "sanity"))
    parser.add_argument("--config")
    parser.add_argument("--force", action="store_true", help="compute what is there already")
    parser.add_argument("--force-figures", action="store_true", help="make figure tables again")
    parser.add_argument("--figures-only", action="store_true", help="the same as the command figures")
    parser.add_argument("--skip-existing", action="store_true", help="leave out cases that are done (the default)")
    parser.add_argument("--dry-run", action="store_true", help="print the cases only")
    parser.add_argument("--tolerate", action="store_true", help="go on after a case that fails")
    parser.add_argument("--retries", type=int, default=0)
    parser.add_argument("--targets", default="", help="some of the target dates, with commas")
    parser.add_argument("--members", default="", help="some of the members, with commas")
    parser.add_argument("--years", default="all", help="all, or some of the years, with commas")
    args = parser.parse_args(argv)
    if args.force and args.skip_existing:
        parser.error("--force and --skip-existing exclude each other")
    if not args.config and args.command != "sanity":
        parser.error("--config is needed")
    listed = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    options = Options(
        args.force, args.force_figures, args.dry_run, args.tolerate, args.retries,
        targets=tuple(listed(args.targets)), members=tuple(map(int, listed(args.members))),
        years=() if args.years == "all" else tuple(map(int, listed(args.years))),
    )
    spark = build_session()
    cfg = readers.Config.read(args.config) if args.config else None
    if args.command == "sanity":
        if cfg:
            plan(spark, cfg, replace(options, dry_run=True))
        for row in sinks.report_metrics(sanity(spark), DIGITS):
            print(row)
    elif args.command == "plan":
        plan(spark, cfg, options)
    elif args.command == "figures" or args.figures_only:
        print("\n".join(figures(spark, cfg)))
    elif args.command == "skill":
        made = repeated(lambda: skill(spark, cfg, options), options.retries, options.wait)
        made.groupBy("extreme", "lead").agg(F.count("*").alias("n_cells"), F.max("n_samples").alias("n_samples")).orderBy("extreme", "lead").show()
        print("\n".join(figures(spark, cfg)))
    else:
        for row in postprocess(spark, cfg, options):
            print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
