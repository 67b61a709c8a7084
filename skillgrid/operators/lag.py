"""A lagged ensemble against an analysis: from member steps to skill maps, all leads and both
extremes in one plan.

Every season has members that start six hours apart around its first day; a lead is a number
of days after that day. Leads and extremes are keys of shared tables, so forecast and
analysis are read once each, however many maps are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.nulls import as_number, nan_to_null
from . import daily, extremes, verification

#: Of each extreme: its side, the daily value it looks at, and its percentile.
EXTREMES = {"heat": ("hot", "high", 90), "cold": ("cold", "low", 10)}
MONTH, DAY = 11, 1


def season_start(year: Column) -> Column:
    return F.make_date(year, F.lit(MONTH), F.lit(DAY))


def snapshots(raw: DataFrame, leads: list[int], cell: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """year, sample, lead_days, cell, high, low: daily extremes of each member on the days
    of the leads, from rows with year, sample, the time axis and a value. If raw has the
    columns file and error, rows with an error stay as rows with no lead, one for each file."""
    start = season_start(F.col("year"))
    rows = daily.with_valid_time(raw, temporal.lag_init(start.cast("timestamp_ntz"), F.col("sample")), time)
    lead, x = F.datediff(F.to_date("ts"), start), nan_to_null(F.col(value).cast("double"))
    failures = [c for c in ("file", "error") if c in raw.columns]
    rows = rows.withColumn("lead_days", lead)
    wanted = F.col("lead_days").isin(*leads)
    if failures:
        rows = rows.where(wanted | F.col("error").isNotNull())
        rows = rows.withColumn("lead_days", F.when(F.col("error").isNull(), F.col("lead_days"))).withColumn("file", F.when(F.col("error").isNotNull(), F.col("file")))
    else:
        rows = rows.where(wanted)
    return rows.groupBy("year", "sample", "lead_days", *cell, *failures).agg(F.max(x).alias("high"), F.min(x).alias("low"))


def complete_years(snaps: DataFrame, members: int, leads: list[int]) -> DataFrame:
    """year, n_members (least over the leads), n_failed (files), complete: whether all
    members are there at all leads and none of the year's files failed."""
    failed = F.col("error").isNotNull() if "error" in snaps.columns else F.lit(False)
    by_lead = snaps.groupBy("year", "lead_days").agg(F.count_distinct(F.when(~failed, F.col("sample"))).alias("n"), F.count_if(failed).alias("f"))
    there = F.col("lead_days").isNotNull()
    out = by_lead.groupBy("year").agg(
        F.coalesce(F.min(F.when(there, F.col("n"))), F.lit(0)).cast("long").alias("n_members"), F.sum("f").alias("n_failed"), F.count_if(there).alias("_leads")
    )
    ok = (F.col("n_members") == members) & (F.col("n_failed") == 0) & (F.col("_leads") == len(leads))
    return out.select("year", "n_members", "n_failed", ok.alias("complete"))


def climate_and_observed(
    days: DataFrame, leads: dict[str, int], months: dict[str, int], years: list[int], baseline: tuple[int, int], cell: list[str],
    percentiles: dict[str, int] | None = None, date: str = "date",
) -> DataFrame:
    """lead, lead_days, cell, hot, cold (quantiles of high and low over the days of the
    lead's month in the baseline years) and seen, an array of year, high and low on the
    target days; in one pass over days of cell, date, high and low."""
    pct = {e: p for e, (_, _, p) in EXTREMES.items()} | (percentiles or {})
    told = F.array(*[F.struct(F.lit(n).alias("lead"), F.lit(d).alias("lead_days"), F.lit(months[n]).alias("month")) for n, d in leads.items()])
    rows = days.withColumn("_l", F.explode(told)).select(*cell, F.col(date).alias("date"), "high", "low", "_l.*")
    start = F.date_sub("date", F.col("lead_days"))
    target = (F.month(start) == MONTH) & (F.dayofmonth(start) == DAY) & F.year(start).isin(*years)
    base = (F.month("date") == F.col("month")) & F.year("date").between(*baseline)
    rows = rows.where(target | base)
    of_base = lambda c: F.when(base, nan_to_null(F.col(c).cast("double")))
    return rows.groupBy("lead", "lead_days", *cell).agg(
        F.percentile(of_base("high"), pct["heat"] / 100).alias("hot"), F.percentile(of_base("low"), pct["cold"] / 100).alias("cold"),
        F.collect_list(F.when(target, F.struct(F.year(start).alias("year"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low")))).alias("seen"),
    )


def verification_pairs(snaps: DataFrame, climate: DataFrame, cell: list[str]) -> DataFrame:
    """extreme, lead, cell, year, probability, observed for both extremes of all leads."""
    members = snaps.where(F.col("lead_days").isNotNull()).join(climate.select("lead", "lead_days", *cell, "hot", "cold"), ["lead_days", *cell])
    hit = lambda side, x: as_number(extremes.event(nan_to_null(F.col(x).cast("double")), F.col(side), side))
    mean = [F.avg(hit(side, x)).alias(e) for e, (side, x, _) in EXTREMES.items()]
    forecast = members.groupBy("lead", *cell, "year").agg(*mean)
    seen = climate.select("lead", *cell, "hot", "cold", F.inline("seen"))
    seen = seen.select("lead", *cell, "year", *[hit(side, x).alias(f"seen_{e}") for e, (side, x, _) in EXTREMES.items()])
    both = forecast.join(seen, ["lead", *cell, "year"])
    one = [F.struct(F.lit(e).alias("extreme"), F.col(e).alias("probability"), F.col(f"seen_{e}").alias("observed")) for e in EXTREMES]
    return both.select("lead", *cell, "year", F.inline(F.array(*one)))


def skill_maps(pairs: DataFrame, cell: list[str]) -> DataFrame:
    """Rank statistics and Brier scores over the years, for each extreme, lead and cell."""
    return verification.rank_skill(pairs, ["extreme", "lead", *cell])
