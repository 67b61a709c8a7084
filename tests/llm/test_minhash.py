import random
from collections import defaultdict

import pytest

from skillgrid.llm import minhash as M
from skillgrid.llm.common import Scratch
from skillgrid.llm.graph import components

from .data import empty_documents, odd_documents, words


def brute(rows, size, percent=80):
    """n_shingles and component of each row by comparing all pairs."""
    nodes = defaultdict(list)
    out = []
    for k, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
        out.append((k, len(s)))
        if k is not None and s:
            nodes[k].append(s)
    top = {k: k for k, _ in rows if k is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(100 * len(s & t) >= percent * len(s | t) for s in nodes[a] for t in nodes[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return sorted(((k, n, None if k is None else find(k)) for k, n in out), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_odd_rows_equal_all_pairs(spark, size):
    df = odd_documents(spark)
    out = M.near_duplicates(df, size=size)
    assert got(out) == brute([(r["doc_id"], r["text"]) for r in df.collect()], size)
    assert all(r["kept"] == (r["component_id"] is None or r["component_id"] == r["doc_id"]) for r in out.collect())


@pytest.mark.parametrize("small", [0, 512])
def test_families_near_the_threshold(spark, monkeypatch, small):
    """Copies with several edits each lie around the threshold; a shared passage makes
    buckets of documents that are no copies."""
    monkeypatch.setattr(M, "SMALL", small)
    rng = random.Random(9)
    rows, k = [], 0
    for family in range(3):
        base = words(rng, 90).split()
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((k, " ".join(w)))
            k += 1
    passage = words(rng, 60)
    for _ in range(60):
        rows.append((k, words(rng, rng.randint(3, 25)) + " " + passage))
        k += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(M.near_duplicates(df, size=4)) == brute(rows, 4)


def test_no_rows(spark):
    assert M.near_duplicates(empty_documents(spark)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    rng = random.Random(2)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    df = spark.createDataFrame(edges, "u long, v long")
    out = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    assert out == {n: 100 for n in range(100, 141)} | {n: 1 for n in range(1, 60)} | {200: 200, 201: 200, 202: 200}
    assert components(df.where("u < 0"), Scratch(spark, "t")).count() == 0
