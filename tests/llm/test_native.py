"""Line dedup and mixing against their SQL and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skillgrid.llm import lines, mixing
from skillgrid.llm.catalogue import ORACLES, QUERIES

from ..duck import connect, rows_of, same
from .data import empty_documents, odd_documents, words


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    same(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


def sql_on(df, con, sql):
    con.register("documents", df.toPandas())
    con.execute(sql)
    return rows_of([d[0] for d in con.description], con.fetchall())


@pytest.mark.parametrize("name,run", [("op4_line_dedup", lambda d: lines.drop_boilerplate(d.select("doc_id", "source", "text"))), ("op7_source_mixing", None)])
def test_odd_rows_equal_sql(spark, tmp_path, name, run):
    import duckdb

    df = odd_documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)) if run is None else run(df), con, ORACLES[name])


def test_lines(spark):
    rng = random.Random(1)
    rows = [(i, "h", f"{words(rng, 5)}\n  Menu line \n\n{words(rng, 5)}\n{words(rng, 4)}") for i in range(40)] + [(100, "other", "Menu line\n" + words(rng, 9)), (101, "h", None), (102, "h", "Menu line\nMenu line\nx")]
    out = {r["doc_id"]: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all("Menu" not in out[i]["text"] and out[i]["n_dropped"] == 1 and out[i]["text"].count("\n") == 3 for i in range(40))
    assert out[100]["n_dropped"] == 0 and out[101]["text"] is None and out[101]["n_lines"] == 0
    assert out[102]["text"] == "x" and out[102]["n_dropped"] == 2


def test_copies_count_unless_asked_otherwise(spark):
    rng = random.Random(2)
    page = "\n".join(words(rng, 6) for _ in range(6))
    rows = [(i, "h", page) for i in range(30)] + [(50 + i, "h", words(rng, 30)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert lines.drop_boilerplate(df).where("n_dropped = 6 and text = ''").count() == 30
    assert lines.drop_boilerplate(df, copies_once=True).where("n_dropped > 0").count() == 0


def plain_lines(rows, ratio):
    """Ratio of pages with the line, by hand."""
    pages, on = {}, {}
    solid = lambda x: x.strip(" \t\r")
    for _, host, text in rows:
        pages[host] = pages.get(host, 0) + 1
        for x in {solid(x) for x in (text or "").split("\n")} - {""}:
            on[host, x] = on.get((host, x), 0) + 1
    bad = {k for k, n in on.items() if n >= 2 and n > ratio * pages[k[0]]}
    return sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, solid(x)) not in bad)) for i, h, t in rows)


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    shared = [words(rng, 3) for _ in range(12)] + ["", "  ", "\t"]
    rows = [(i, f"h{rng.randint(0, 4) ** 2}", "\n".join(rng.choice(["", " ", "\r"]) + (rng.choice(shared) if rng.random() < 0.3 else words(rng, 3)) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    rows += [(1000, "h0", None), (1001, "one", "alone\nalone"), (1002, "two", "here\nx"), (1003, "two", "here\ny"), (1004, "h0", "z\n" * 50_000)]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == plain_lines(rows, lines.RATIO)


def test_no_rows(spark):
    assert lines.drop_boilerplate(empty_documents(spark)).count() == 0
    assert mixing.mix(mixing.with_domain(empty_documents(spark))).count() == 0


def fill(budget, caps, weights):
    """Shares of a budget by hand: what is full leaves the sharing."""
    got, open_ = [0.0] * len(caps), set(range(len(caps)))
    while open_:
        level = (budget - sum(got[i] for i in range(len(caps)) if i not in open_)) / sum(weights[i] for i in open_)
        full = {i for i in open_ if caps[i] <= level * weights[i]}
        if not full:
            for i in open_:
                got[i] = level * weights[i]
            break
        for i in full:
            got[i] = caps[i]
        open_ -= full
    return [int(x + 1e-9) for x in got]


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000), ("b", "x", "2", 5)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    out = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(df, mixing.LEVELS, {}, 0.4, 1).collect()}
    total = int(3015 * 0.4)
    a, b = fill(total, [2010, 1005], [1, 1])
    ax, ay = fill(a, [1010, 1000], [1, 1])
    a1, a2 = fill(ax, [10, 1000], [1, 1])
    b1, b2 = fill(b, [1000, 5], [1, 1])
    assert out == {("a", "x", "1"): a1, ("a", "x", "2"): a2, ("a", "y", "1"): ay, ("b", "x", "1"): b1, ("b", "x", "2"): b2}
    assert a1 == 10 and a2 == ax - 10  # the sibling source took the shortage, not the language


def test_prefix_is_within_budget_and_near_it(spark, sf_dir):
    docs = mixing.with_domain(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = mixing.mix(docs, share=0.5)
    spent = {tuple(r)[:3]: r["n"] for r in out.groupBy("leaf_domain", "leaf_lang", "leaf_source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert spent and out.where("epoch > 2").count() == 0
    again = mixing.mix(docs.repartition(7), share=0.5)
    assert sorted((r["doc_id"], r["epoch"]) for r in out.collect()) == sorted((r["doc_id"], r["epoch"]) for r in again.collect())


def test_ranges_of_any_size_give_one_result(spark, sf_dir, monkeypatch):
    docs = mixing.with_domain(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = docs.union(docs.where("doc_id < 20")).union(docs.where("doc_id = 3"))
    rows = lambda: sorted(tuple(r) for r in mixing.mix(docs, share=0.5, keep=("doc_id",)).collect())
    want = rows()
    for most in (16, 2, 0):  # 0 goes on until the digits end
        monkeypatch.setattr(mixing, "RANGE_ROWS", most)
        assert rows() == want


def test_words(spark):
    texts = ["", " ", "a", " a ", "\t\n\x0b\f\r", "\ra\x0bb\n\n", "a b  c\td\r\ne\ff", "\xa0 x\u2003y", "é\U0001f642 \x00", None] + [w * 3 for w in ("x\n", " y", "\x0b", "\x1c z")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words(F.col("t"))).collect()
    assert [r[0] for r in got] == [len([w for w in re.split("[ \t\n\x0b\f\r]+", t or "") if w]) for t in texts]


def test_weights_of_zero(spark):
    leaves = [("a", "x", "1", 100), ("a", "x", "2", 100), ("b", "x", "1", 200)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    out = {(r["domain"], r["source"]): r["budget"] for r in mixing.budgets(df, mixing.LEVELS, {"domain": {"b": 0}}, 0.25, 1).collect()}
    assert out == {("a", "1"): 50, ("a", "2"): 50}  # a quarter of all 400 tokens
    # what no leaf can take is not spent
    out = {(r["domain"], r["source"]): r["budget"] for r in mixing.budgets(df, mixing.LEVELS, {"domain": {"b": 0}}, 0.75, 1).collect()}
    assert out == {("a", "1"): 100, ("a", "2"): 100}


def test_plans_have_no_python(spark, sf_dir):
    for name in ("op4_line_dedup", "op7_source_mixing"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def test_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("_host", "_lines", "split", "left", "n", "t", "n_lines", "row", "range", "last", "whole", "rest", "times", "k", "n_tokens", "epoch", "leaf_lang", "budget", "place")
    odd = docs.selectExpr("*", *[f"'clash' as `{n}`" for n in names])
    a, b = lines.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped"), lines.drop_boilerplate(odd)
    assert b.where("`left` = 'clash' and split = 'clash'").count() == docs.count() and a.exceptAll(b.select(a.columns)).count() == 0
    a, b = mixing.mix(mixing.with_domain(docs)), mixing.mix(mixing.with_domain(odd))
    assert set(b.columns) == set(names) | set(a.columns)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.count() == a.count()
