import math

import pytest
from pyspark.sql import functions as F

from skillgrid.llm import quality as Q

from .data import empty_documents, odd_documents

LABEL = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_clean_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    got = Q.score(docs, train).join(labels.where("doc_id % 2 = 1").selectExpr("doc_id", "quality as y"), "doc_id").select("keep", "y").collect()
    assert sum(r["keep"] == bool(r["y"]) for r in got) / len(got) > 0.95
    clean = [r for r in got if r["y"]]
    assert sum(r["keep"] for r in clean) / len(clean) > 0.98


def test_sparse_sites_follow_the_prior(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rare = docs.limit(1).withColumn("source", F.lit("rare"))
    out = Q.score(docs.union(rare), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rates = {r["host"]: r["host_rate"] for r in out.select("host", "host_rate").distinct().collect()}
    assert min(rates.values()) <= rates["rare"] <= max(rates.values())


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (4, 1, 1)]])
def test_odd_rows(spark, labels):
    df = odd_documents(spark)
    out = Q.score(df, spark.createDataFrame(labels, LABEL))
    assert out.count() == df.count()
    assert out.where("quality is null or quality < 0 or quality > 1 or keep is null").count() == 0


def test_no_rows(spark):
    assert Q.score(empty_documents(spark), spark.createDataFrame([], LABEL)).count() == 0


def plain_posteriors(rows, labels):
    """Posteriors from (id, host, section, own) one by one."""
    votes = {}
    for k, y in labels:
        if k is not None and y is not None:
            votes.setdefault(k, []).append(y)
    s = [float(sum(votes[k]) / len(votes[k]) >= 0.5) if k in votes else own for k, _, _, own in rows]
    clip = lambda p: min(1 - 1e-4, max(1e-4, p))
    logit = lambda p: math.log(clip(p) / (1 - clip(p)))

    def strength(groups, rate):
        n = sum(len(g) for g in groups.values())
        between = sum(len(g) * (sum(g) / len(g) - rate[k]) ** 2 for k, g in groups.items()) / n
        chance = sum(rate[k] * (1 - rate[k]) for k in groups) / n
        inside = sum(len(g) * rate[k] * (1 - rate[k]) for k, g in groups.items()) / n
        return max(1.0, min(1000.0, inside / max(1e-6, between - chance)))

    hosts, paths = {}, {}
    for (_, h, p, _), x in zip(rows, s):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, p), []).append(x)
    world = sum(s) / len(s)
    a = strength(hosts, dict.fromkeys(hosts, world))
    about = {h: (sum(g) + a * world) / (len(g) + a) for h, g in hosts.items()}
    b = strength(paths, {k: about[k[0]] for k in paths})
    out = []
    for (_, h, p, own), x in zip(rows, s):
        host = (sum(hosts[h]) - x + a * world) / (len(hosts[h]) - 1 + a)
        path = (sum(paths[h, p]) - x + b * host) / (len(paths[h, p]) - 1 + b)
        out.append((host, path, 1 / (1 + math.exp(-(logit(own) + Q.SITE_WEIGHT * (logit(path) - logit(world)))))))
    return out


def test_posteriors_equal_plain_steps(spark, sf_dir):
    odd = odd_documents(spark)
    labels = [(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (4, 1, 1), (40, 0, 0), (61, 1, 0)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, known in ((odd, spark.createDataFrame(labels, LABEL)), (docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))):
        got = Q.score(df, known).collect()
        want = plain_posteriors([(r["doc_id"], r["host"], r["section"], r["own"]) for r in got], [(r["doc_id"], r["quality"]) for r in known.collect()])
        for r, (host, path, quality) in zip(got, want):
            assert abs(r["host_rate"] - host) < 1e-9 and abs(r["path_rate"] - path) < 1e-9 and abs(r["quality"] - quality) < 1e-9
            assert r["keep"] == (r["quality"] >= Q.KEEP)


def test_the_training_sample_has_one_text_of_each_id(spark, monkeypatch):
    rows = [(1, f"good words here {i}", "en", "s", 0) for i in range(500)] + [(2, "!!! ###", "en", "s", 0)]
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, y, fit=Q.fit: seen.append(len(y)) or fit(x, y))
    out = Q.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABEL))
    assert out.count() == 501 and seen == [2]
