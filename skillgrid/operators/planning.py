"""Cases, members, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal

CASE_COLUMNS = ("target_date", "lead_days", "init_time", "required_horizon_days", "required_6hour_steps", "prediction_path", "prediction_exists")


def build_cases(
    spark: SparkSession, target_dates: list[str] | DataFrame, lead_days: list[int], pattern: str, existing: DataFrame | None = None
) -> DataFrame:
    """A row for each target date and lead, in the order of the lists (of a table with the
    column target, by date). The pattern has the fields target_yyyymmdd, init_yyyymmdd, lead
    and horizon; `existing` has a column path. Leads are a short list, so the product with
    them is as long as what it returns."""
    if isinstance(target_dates, DataFrame):
        targets = target_dates.select(F.col("target").alias("t"), F.to_date("target").alias("target"))
    else:
        targets = spark.createDataFrame(list(enumerate(target_dates)), "t int, target string").withColumn("target", F.to_date("target"))
    leads = spark.createDataFrame([(i, n) for i, n in enumerate(lead_days)], "l int, lead_days int")
    out = targets.crossJoin(leads).withColumn("init", F.date_sub("target", F.col("lead_days")))
    path = F.lit(pattern)
    lead = F.col("lead_days").cast("string")
    fields = {"target_yyyymmdd": F.date_format("target", "yyyyMMdd"), "init_yyyymmdd": F.date_format("init", "yyyyMMdd"), "lead": lead, "horizon": lead}
    for field, value in fields.items():
        path = F.replace(path, F.lit("{" + field + "}"), value)
        path = F.replace(path, F.lit("{" + field + ":03d}"), F.lpad(value, 3, "0"))
    out = out.withColumn("prediction_path", path)
    if existing is None:
        out = out.withColumn("prediction_exists", F.lit(False))
    else:
        there = existing.select(F.col("path").alias("prediction_path"), F.lit(True).alias("here")).distinct()
        out = out.join(there, "prediction_path", "left").withColumn("prediction_exists", F.coalesce("here", F.lit(False)))
    return out.orderBy("t", "l").select(
        F.date_format("target", "yyyy-MM-dd").alias("target_date"),
        "lead_days",
        F.date_format("init", "yyyy-MM-dd'T'HH:mm:ss").alias("init_time"),
        F.col("lead_days").alias("required_horizon_days"),
        (F.col("lead_days") * 4).alias("required_6hour_steps"),
        "prediction_path",
        "prediction_exists",
    )


def lag_members(years: DataFrame, month: int = 11, day: int = 1) -> DataFrame:
    """year, sample, init_time, hours_since_epoch and epoch_index of the lagged members."""
    out = years.select("year").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(temporal.MEMBERS - 1))))
    centre = F.make_date("year", F.lit(month), F.lit(day)).cast("timestamp_ntz")
    out = out.withColumn("init_time", temporal.lag_init(centre, F.col("sample")))
    hours = temporal.hours_between(temporal.ntz(temporal.EPOCH), F.col("init_time"))
    return out.withColumns({"hours_since_epoch": hours, "epoch_index": temporal.epoch_index(F.col("init_time"))})


def member_chunks(members: DataFrame, size: int, sample: str = "sample") -> DataFrame:
    """chunk, first_sample, n_members for consecutive members; the last may be short."""
    chunks = members.select(F.col(sample)).distinct().groupBy(F.floor(F.col(sample) / size).alias("chunk"))
    return chunks.agg(F.min(sample).alias("first_sample"), F.count("*").alias("n_members"))


def chunk_manifest(cases: DataFrame, members: DataFrame | int, size: int, root: str, sample: str = "sample") -> DataFrame:
    """A row for each case and chunk of members (a table of them, or their number): where it
    runs and what it must make."""
    if isinstance(members, int):
        members = cases.sparkSession.range(members).select(F.col("id").cast("int").alias(sample))
    chunks = member_chunks(members, size, sample)
    # members are few, so the product is as long as the manifest
    out = cases.select("target_date", "lead_days", "init_time", "required_6hour_steps").crossJoin(chunks)
    case = F.concat_ws("_", F.replace("target_date", F.lit("-"), F.lit("")), F.format_string("%03d", "lead_days"))
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), case, F.format_string("chunk_%02d", "chunk"))
    steps = F.col("required_6hour_steps").alias("expected_steps")
    return out.select("target_date", "lead_days", "init_time", "chunk", F.col("n_members").alias("members"), folder.alias("output_dir"), steps)


def pick_of(totals: DataFrame, most: int, total: str = "total") -> DataFrame:
    """sample: evenly spaced members of the `total` that a table of one row tells, the first
    and the last included."""
    n = F.greatest(F.lit(0), F.least(F.lit(most), F.col(total))).cast("int")
    rows = totals.select(F.col(total).alias("total"), n.alias("n")).where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    step = F.when(F.col("n") > 1, F.try_divide(F.col("total") - 1, F.col("n") - 1)).otherwise(F.lit(0.0))
    # whole part of evenly spaced places; the last one is exact, not a product of roundings
    place = F.when((F.col("i") == F.col("n") - 1) & (F.col("i") > 0), F.col("total") - 1).otherwise(F.floor(F.col("i") * step))
    return rows.select(place.cast("int").alias("sample")).distinct()


def pick_members(spark: SparkSession, total: int, most: int) -> DataFrame:
    """The same for a number that is known."""
    return pick_of(spark.range(1).select(F.lit(total).alias("total")), most)


def case_counts(pairs: DataFrame, case: list[str], cell: list[str]) -> DataFrame:
    """n_cases (rows), n_years (distinct cases) and n_cells."""
    return pairs.agg(F.count("*").alias("n_cases"), F.count_distinct(*case).alias("n_years"), F.count_distinct(*cell).alias("n_cells"))


def levels(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """keys, level, value: an array's places as a new axis."""
    return df.select(*keys, F.posexplode(values).alias("level", "value"))


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be made: rows of `wanted` whose keys are not in `have`."""
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def completeness(df: DataFrame, keys: list[str], sample: str, step: str, members: int, steps: int) -> DataFrame:
    """n_members, n_steps and whether these are as many as expected (members exactly,
    unless 0; steps at least)."""
    out = df.groupBy(*keys).agg(F.count_distinct(sample).alias("n_members"), F.count_distinct(step).alias("n_steps"))
    ok = (F.col("n_steps") >= steps) & (F.lit(members == 0) | (F.col("n_members") == members))
    return out.withColumn("complete", ok)


def has_columns(have: Column, required: list[str]) -> Column:
    """Whether an array of names holds all required ones."""
    return F.size(F.array_except(F.array(*[F.lit(x) for x in required]), have)) == 0


def stack_samples(parts: list[DataFrame], sample: str = "sample", chunk: int = 5) -> DataFrame:
    """Chunks of an ensemble as one, members numbered through."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn(sample, F.col(sample) + i * chunk)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no chunks")
    return out
