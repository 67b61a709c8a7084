"""Scores of probabilities and values against observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import area_weight
from ..functions.nulls import exceeds, finite, nan_to_null, pearson
from ..functions.rankstats import correlation_p, normal_p

#: Climatological Brier score of an event with a share of one in ten.
CLIMATE_BRIER = 0.1 * (1 - 0.1)


def case_metrics(df: DataFrame, case: list[str], prob: str = "probability", obs: str = "observed", forecast: str | None = None, truth: str | None = None) -> DataFrame:
    """Scores over the cells of each case, from rows in which all fields are finite. The
    skill score is NULL if the observations do not vary, the correlation if either side
    does not. Without value columns bias and rmse are NULL."""
    values = [c for c in (forecast, truth) if c]
    rows = df.where(finite(*[F.col(c) for c in (prob, obs, *values)]))
    p, o = F.col(prob), F.col(obs)
    miss = F.pow(p - o, 2)
    off = F.col(forecast) - F.col(truth) if forecast and truth else F.lit(None).cast("double")
    return rows.groupBy(*case).agg(
        F.avg(o).alias("frac_obs_extreme"), F.avg(p).alias("mean_pred_prob"), F.avg(miss).alias("brier_score"),
        (1 - F.try_divide(F.avg(miss), F.var_pop(o))).alias("brier_skill_score"), pearson(p, o).alias("spatial_corr_prob_obs"),
        F.avg(off).alias("pred_tmax_bias_C"), F.sqrt(F.avg(off * off)).alias("pred_tmax_rmse_C"), F.count("*").alias("n_cells"),
    )


def _ranked(points: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Within keys: the number of rows with the value of `column`, its average rank, and the
    place of the value among the distinct ones, in one sort."""
    w = Window.partitionBy(*keys).orderBy(column)
    same = F.sum("w").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    points = points.withColumns({f"_t_{column}": same, f"_u_{column}": F.sum("w").over(w), f"_d_{column}": F.dense_rank().over(w) - 1})
    return points.withColumn(f"_r_{column}", F.col(f"_u_{column}") - (F.col(f"_t_{column}") - 1) / 2)


#: Digit of the rows that carry a point's own sums instead of a comparison.
OWN = -1


def concordance(points: DataFrame, keys: list[str], also: dict[str, Column] | None = None) -> DataFrame:
    """keys and _s, concordant minus discordant pairs, of weighted points (p, o, w), and
    the sums `also` of columns of the points, in one pass.

    The values of one side become whole numbers in order, the side with fewer of them. Two
    points whose numbers differ do so first in one binary digit: above it they share a
    prefix, and the one with a 0 there is the lower. So each point goes to one group for
    each digit, and there every 1 meets all 0 in two running sums along the other side. The
    work is n log n, rows are dealt by digit and prefix, and no task holds a list of points.
    An event has two values, thus a single digit."""
    also, whole = also or {}, Window.partitionBy(*keys)
    if "_d_p" not in points.columns:
        points = _ranked(_ranked(points, keys, "p"), keys, "o")
    ranked = points.select(*keys, "w", F.col("_d_p").alias("_p"), F.col("_d_o").alias("_o"), *[x.alias(c) for c, x in also.items()])
    ranked = ranked.withColumns({"_mp": F.max("_p").over(whole), "_mo": F.max("_o").over(whole)})
    swap = F.col("_mp") < F.col("_mo")
    few, many = F.when(swap, F.col("_p")).otherwise(F.col("_o")), F.when(swap, F.col("_o")).otherwise(F.col("_p"))
    digits = F.length(F.bin(F.least("_mp", "_mo")))
    rows = ranked.select(*keys, F.col("w").cast("double").alias("w"), few.cast("long").alias("_a"), many.alias("_b"), *also, F.explode(F.sequence(F.lit(OWN), digits - 1)).alias("_digit"))
    own, place = F.col("_digit") == OWN, F.call_function("shiftright", F.col("_a"), F.greatest(F.col("_digit"), F.lit(0)))
    rows = rows.select(
        *keys, "_digit", F.when(own, 0).otherwise(F.floor(place / 2)).alias("_prefix"), F.when(own, 0).otherwise(F.col("_b")).alias("_b"),
        F.when(own | (place % 2 == 1), 0.0).otherwise(F.col("w")).alias("w0"), F.when(own | (place % 2 == 0), 0.0).otherwise(F.col("w")).alias("w1"),
        *[F.when(own, F.col(c)).alias(c) for c in also],
    )
    group = [*keys, "_digit", "_prefix"]
    totals = lambda *columns: [F.sum(c).alias(c) for c in (*columns, *also)]
    rows = rows.repartition(*group).groupBy(*group, "_b").agg(*totals("w0", "w1"))
    below = F.sum("w0").over(Window.partitionBy(*group).orderBy("_b"))
    # of the 0s those under a 1 count up and those over it down; equal ones do neither
    each = rows.withColumn("_up", F.col("w1") * (2 * below - F.col("w0"))).groupBy(*group)
    each = each.agg((F.sum("_up") - F.sum("w1") * F.sum("w0")).alias("_s"), *totals())
    return each.groupBy(*keys).agg(*totals("_s"))


def rank_skill(df: DataFrame, keys: list[str], prob: str = "probability", obs: str = "observed") -> DataFrame:
    """keys, n, brier, rho, rho_p, tau, tau_z, tau_p over the rows of each key. Only the Brier
    score is defined where the observations do not vary; rank statistics are NULL there and
    where the probabilities do not vary. Null keys are keys like any other.

    Equal pairs of a key become one point with a weight first, before anything moves: an
    ensemble has few distinct probabilities and an event two outcomes. Ranks are running
    sums over the sorted points of a key, so long series of distinct pairs are sorted, on disk
    if need be, and never collected."""
    rows = df.select(*keys, F.col(prob).cast("double").alias("p"), F.col(obs).cast("double").alias("o")).where("p is not null and o is not null")
    points = rows.groupBy(*keys, "p", "o").agg(F.count("*").alias("w"))
    points = _ranked(_ranked(points, keys, "p"), keys, "o")
    # ranks have the mean (n + 1) / 2 exactly
    middle = (F.sum("w").over(Window.partitionBy(*keys)) + 1) / 2
    points = points.withColumn("_dp", F.col("_r_p") - middle).withColumn("_do", F.col("_r_o") - middle)
    w, t = F.col("w").cast("double"), lambda c: F.col(f"_t_{c}")
    sums = {
        "n": F.col("w"), "_off": w * F.pow(F.col("p") - F.col("o"), 2),
        "_cov": w * F.col("_dp") * F.col("_do"), "_vp": w * F.col("_dp") * F.col("_dp"), "_vo": w * F.col("_do") * F.col("_do"),
    }
    for c in ("p", "o"):
        # sums over tie groups of t (t - 1) / 2, t (t - 1)(t - 2) and t (t - 1)(2 t + 5)
        sums |= {f"_{c}tie": w * (t(c) - 1) / 2, f"_{c}0": w * (t(c) - 1) * (t(c) - 2), f"_{c}1": w * (t(c) - 1) * (2 * t(c) + 5)}
    out = concordance(points, keys, sums).withColumn("brier", F.col("_off") / F.col("n"))
    n = F.col("n").cast("double")
    pairs, m = n * (n - 1) / 2, n * (n - 1)
    tau = F.try_divide(F.col("_s"), F.sqrt((pairs - F.col("_ptie")) * (pairs - F.col("_otie"))))
    three = F.coalesce(F.try_divide(F.col("_p0") * F.col("_o0"), 9 * m * (n - 2)), F.lit(0.0))
    var = (m * (2 * n + 5) - F.col("_p1") - F.col("_o1")) / 18 + F.try_divide(2 * F.col("_ptie") * F.col("_otie"), m) + three
    varies = F.col("_vo") > 0
    rho = F.try_divide(F.col("_cov"), F.sqrt(F.col("_vp") * F.col("_vo")))
    out = out.withColumn("rho", F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))))
    out = out.withColumn("tau", F.when(varies, tau)).withColumn("tau_z", F.when(F.col("tau").isNotNull(), F.try_divide(F.col("_s"), F.sqrt(var))))
    made = (correlation_p(F.col("rho"), F.col("n")).alias("rho_p"), "tau", "tau_z", normal_p(F.col("tau_z")).alias("tau_p"))
    return out.select(*keys, "n", "brier", "rho", *made)


def area_mean(df: DataFrame, by: list[str], value: str, lat: str = "lat") -> DataFrame:
    """Mean weighted by cos(lat) over rows with a value; NULL if there are none."""
    x = nan_to_null(F.col(value).cast("double"))
    w = F.when(x.isNotNull(), area_weight(F.col(lat)))
    return df.groupBy(*by).agg(F.try_divide(F.sum(x * w), F.sum(w)).alias("area_mean"))


def area_means(df: DataFrame, values: list[str], lat: str = "lat") -> DataFrame:
    """One row: the mean of each of `values`, weighted by cos(lat) over rows that have it."""
    each = F.array(*[F.struct(F.lit(c).alias("_of"), F.col(c).cast("double").alias("_x")) for c in values])
    means = area_mean(df.select(F.col(lat).alias("_lat"), F.inline(each)), ["_of"], "_x", "_lat")
    return means.agg(*[F.max(F.when(F.col("_of") == c, F.col("area_mean"))).alias(f"{c}_mean") for c in values])


def error_limits(df: DataFrame, case: list[str], prob: str = "probability", obs: str = "observed") -> DataFrame:
    """case, worst (greatest absolute error), n_cells and n_events."""
    return df.groupBy(*case).agg(
        F.max(F.abs(F.col(obs) - F.col(prob))).alias("worst"), F.count("*").alias("n_cells"), F.count_if(F.col(obs) == 1).alias("n_events")
    )


def stippled(skill: DataFrame, alpha: float = 0.05, brier: float = CLIMATE_BRIER) -> DataFrame:
    """skill with the marks of insignificant cells; undefined p-values are not marked."""
    a, b = F.lit(alpha), F.lit(brier)
    marks = {"rho": exceeds(F.col("rho_p"), a), "tau": exceeds(F.col("tau_p"), a), "brier": exceeds(F.col("brier"), b)}
    return skill.withColumns({f"{name}_stipple": mark for name, mark in marks.items()})
