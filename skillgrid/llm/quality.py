"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier on counts of each whole text gives the document's own evidence.
Its mean over a host, and over a path of the host (here: host and section column), are
shrunk: a path toward its host and a host toward the global rate. Each strength is found
by moments: how much hosts differ from the global rate, and paths from the rate of their
own host, beyond chance. Both means leave the document itself out. A document's posterior
odds are its own odds times those of its path over the global ones, to the power of
SITE_WEIGHT. Labels, where known, stand in for the classifier in the means.

Sparse sites thus follow the prior and large ones their own record. Host and path sums
are grouped aggregates with map-side combining, so a host with a third of all rows costs
no more than others.

The classifier is fitted on a bounded sample: about SAMPLE_ROWS labelled ids, those with
the smallest hash, and one text of each (that with the least hash, if an id has several).
Disagreeing labels of one id count by majority, ties as good. Without both classes in the
sample the classifier says 0.5 for every document. Null or empty texts are scored as texts
without words, very long ones whole. Null hosts and sections count as "". Rows with equal
ids and repeated rows are scored row by row, and all count in the means. An empty table
gives no rows; other columns of the documents are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, load, map_batches

SAMPLE_ROWS = 12_000
#: A document is kept if its posterior is at least this.
KEEP = 0.5
#: Weight of the path's odds against the document's own.
SITE_WEIGHT = 0.5
RIDGE = 1.0
_MARKS = re.compile(r"[^\w\s.,;:'\"()\-]")


def features(text: str | None) -> list[float]:
    text = text or ""
    words, n = text.split(), max(1, len(text))
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = len(_MARKS.findall(text))
    upper = sum(map(str.isupper, words))
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(len(words)), np.log1p(len(text) / m), marks / n, marks / m, upper / m, sum(w[-1] in "!?*#%&$@|" for w in words) / m,
        top / m, len(counts) / m, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))), text.count("|") / m,
        sum(map(str.isdigit, text)) / n, sum(w[-1] in ".," for w in words) / m, text.count("http") / m, np.log1p(max(map(len, words), default=0)), 1.0,
    ]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> dict[str, list[float]]:
    """Ridge logistic regression by Newton steps on standardised features."""
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-9] = 0.0, 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weight": w.tolist()}


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """k, y: the label of each id by majority, ties as good."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y")).where("k is not null and y is not null")
    return known.groupBy("k").agg((F.avg("y") >= 0.5).cast("double").alias("y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> dict[str, list[float]] | None:
    known = _known(labels, id_col, label_col)
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    if share < 1:
        known = known.where(F.xxhash64("k") < F.lit(int((share - 0.5) * 2.0**64)))
    # SAMPLE_ROWS ids and labels in expectation, whatever the size of the tables
    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(known), "k")
    rows = rows.groupBy("k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    found = map_batches(rows, "x array<double>, y double", lambda r: {"x": list(map(features, r["t"])), "y": r["y"]}, "t").collect()
    x, y = np.array([r["x"] for r in found], float), np.array([r["y"] for r in found], float)
    return fit(x, y) if len(y) and 0 < y.mean() < 1 else None


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _strength(s: Column, n: Column, rate: Column) -> Column:
    """An aggregate over groups with the sums s of n rows: the prior rows of a beta prior
    about `rate` by moments, rate (1 - rate) over the variance of the groups' means beyond
    that of sampling, between 1 and 1000."""
    inside = rate * (1 - rate)
    spread = F.sum(n * F.pow(s / n - rate, 2)) / F.sum(n)
    chance = F.sum(inside) / F.sum(n)
    return F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.sum(n * inside) / F.sum(n) / F.greatest(F.lit(1e-6), spread - chance)))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", section_col: str = "lang", label_col: str = "quality"
) -> DataFrame:
    """id, host, section, own (classifier), host_rate and path_rate (shrunk, without the
    document), quality and keep."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    model = train(docs, labels, id_col, text_col, label_col)
    kind = dict(docs.dtypes)[id_col]

    def work(r: dict[str, list]) -> dict[str, list]:
        own = np.full(len(r["k"]), 0.5)
        if model:
            x = np.array(list(map(features, r["t"])))
            own = 1 / (1 + np.exp(-np.clip((x - model["mean"]) / model["scale"] @ model["weight"], -30, 30)))
        return {"k": r["k"], "host": r["host"], "section": r["section"], "own": own}

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((host_col, "host"), (section_col, "section"))]
    rows = map_batches(docs.select(F.col(id_col).alias("k"), *named, F.col(text_col).alias("t")), f"k {kind}, host string, section string, own double", work, "t")
    rows = scratch.table(rows)
    seen = scratch.table(rows.join(_known(labels, id_col, label_col), "k", "left").select("k", "host", "section", "own", F.coalesce("y", "own").alias("s")))
    paths = scratch.table(seen.groupBy("host", "section").agg(F.count("*").cast("double").alias("n"), F.sum("s").alias("s")))
    hosts = scratch.table(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")))
    # two rows of one number each: the global rate and the strengths
    world = hosts.agg((F.sum("hs") / F.sum("hn")).alias("p")).first()["p"]
    world = 0.5 if world is None else float(world)
    of_hosts = hosts.agg(_strength(F.col("hs"), F.col("hn"), F.lit(world)).alias("v")).first()["v"] or 1.0
    about = (F.col("hs") + of_hosts * world) / (F.col("hn") + of_hosts)
    sites = scratch.table(paths.join(hosts, "host"))
    of_paths = sites.agg(_strength(F.col("s"), F.col("n"), about).alias("v")).first()["v"] or 1.0
    out = seen.join(scratch.hint(sites.withColumnRenamed("s", "ps")), ["host", "section"])
    out = out.withColumn("host_rate", (F.col("hs") - F.col("s") + of_hosts * world) / (F.col("hn") - 1 + of_hosts))
    out = out.withColumn("path_rate", (F.col("ps") - F.col("s") + of_paths * F.col("host_rate")) / (F.col("n") - 1 + of_paths))
    odds = _logit(F.col("own")) + SITE_WEIGHT * (_logit(F.col("path_rate")) - _logit(F.lit(world)))
    out = out.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("k").alias(id_col), "host", "section", "own", "host_rate", "path_rate", "quality", (F.col("quality") >= KEEP).alias("keep"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
