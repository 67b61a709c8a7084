"""Rank statistics against direct computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skillgrid.functions.rankstats import correlation_p
from skillgrid.operators.verification import rank_skill


def student_p(r, n, steps=20000):
    """Two-sided p by integrating the density of Student's t."""
    nu = n - 2
    if abs(r) >= 1:
        return 0.0
    t = abs(r) * math.sqrt(nu / (1 - r * r))
    c = math.gamma((nu + 1) / 2) / (math.sqrt(nu * math.pi) * math.gamma(nu / 2))
    f = lambda x: c * (1 + x * x / nu) ** (-(nu + 1) / 2)
    h = t / steps
    area = h / 3 * sum(f(i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))
    return 1 - 2 * area


@pytest.mark.parametrize("n", [3, 4, 5, 7, 10, 21])
def test_correlation_p(spark, n):
    rs = [0.1, 0.5, -0.9, 1.0]
    rows = spark.createDataFrame([(r, n) for r in rs], "r double, n int")
    got = [x[0] for x in rows.select(correlation_p(F.col("r"), F.col("n"))).collect()]
    assert got == pytest.approx([student_p(r, n) for r in rs], abs=1e-8)


def test_no_degrees_of_freedom(spark):
    rows = spark.createDataFrame([(1.0, 2), (None, 9)], "r double, n int")
    assert [x[0] for x in rows.select(correlation_p(F.col("r"), F.col("n"))).collect()] == [None, None]


def ranks(xs):
    return [sum(y < x for y in xs) + (xs.count(x) + 1) / 2 for x in xs]


def pearson(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


def kendall(p, o):
    n = len(p)
    sign = lambda x: (x > 0) - (x < 0)
    s = sum(sign(p[i] - p[j]) * sign(o[i] - o[j]) for i in range(n) for j in range(i))
    ties = lambda x: [x.count(v) for v in set(x)]
    n0, m = n * (n - 1) / 2, n * (n - 1)
    half = lambda x: sum(t * (t - 1) / 2 for t in ties(x))
    three, five = (lambda x: sum(t * (t - 1) * (t - 2) for t in ties(x))), (lambda x: sum(t * (t - 1) * (2 * t + 5) for t in ties(x)))
    var = (m * (2 * n + 5) - five(p) - five(o)) / 18 + 2 * half(p) * half(o) / m + (three(p) * three(o) / (9 * m * (n - 2)) if n > 2 else 0)
    z = s / math.sqrt(var)
    return s / math.sqrt((n0 - half(p)) * (n0 - half(o))), z, math.erfc(abs(z) / math.sqrt(2))


def test_rank_skill_with_ties(spark):
    rng = random.Random(5)
    data = {c: [(rng.choice([0.0, 0.2, 0.4, 0.6]), float(rng.random() < 0.4)) for _ in range(n)] for c, n in (("a", 5), ("b", 9), ("c", 30))}
    rows = [(c, p, o) for c, xs in data.items() for p, o in xs]
    got = {r["cell"]: r for r in rank_skill(spark.createDataFrame(rows, "cell string, probability double, observed double"), ["cell"]).collect()}
    for c, xs in data.items():
        p, o = [x[0] for x in xs], [x[1] for x in xs]
        tau, z, q = kendall(p, o)
        rho = pearson(ranks(p), ranks(o))
        assert (got[c]["rho"], got[c]["tau"], got[c]["tau_z"], got[c]["tau_p"]) == pytest.approx((rho, tau, z, q), abs=1e-9)
        assert got[c]["rho_p"] == pytest.approx(student_p(rho, len(xs)), abs=1e-7)
        assert got[c]["brier"] == pytest.approx(sum((a - b) ** 2 for a, b in xs) / len(xs))


def test_rank_skill_gates(spark):
    rows = [("flat_o", 0.1, 0.0), ("flat_o", 0.9, 0.0), ("flat_p", 0.5, 0.0), ("flat_p", 0.5, 1.0), ("two", 0.1, 0.0), ("two", 0.9, 1.0)]
    got = {r["cell"]: r for r in rank_skill(spark.createDataFrame(rows, "cell string, probability double, observed double"), ["cell"]).collect()}
    for c in ("flat_o", "flat_p"):
        assert got[c]["rho"] is None and got[c]["tau"] is None and got[c]["tau_p"] is None and got[c]["brier"] is not None
    assert got["two"]["rho"] == pytest.approx(1.0) and got["two"]["rho_p"] is None and got["two"]["tau"] == pytest.approx(1.0)
