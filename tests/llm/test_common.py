import random
from bisect import bisect_right
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import common as C


def test_search_sorted(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 64, 100):
        bounds = sorted(rng.sample(range(-500, 500), n))
        df = spark.range(-510, 510)
        assert all(r["x"] == bisect_right(bounds, r["id"]) for r in df.select("id", C.search_sorted(bounds, F.col("id")).alias("x")).collect())


def test_slices():
    assert list(C.slices([])) == [] and list(C.slices([9, 9, 9], 10)) == [(0, 1), (1, 2), (2, 3)]
    assert list(C.slices([0, 0, 100, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)] or list(C.slices([0, 0, 100, 1, 1], 10))[-1][1] == 5


def test_scratch_is_under_the_shared_folder(spark):
    s = C.Scratch(spark, "x")
    t = s.table(spark.range(10))
    assert t.count() == 10 and t.inputFiles()[0].startswith(spark.conf.get("spark.checkpoint.dir")) and s.bytes(t) > 0
    assert "broadcast" in s.hint(t)._jdf.queryExecution().toString() and "broadcast" not in s.hint(t, 1)._jdf.queryExecution().toString()
    s.drop()
    assert not there(spark, s)


def there(spark, scratch):
    fs, at = C._filesystem(spark, scratch.base)
    return fs.exists(at)


def test_owners_drop_their_own_tables(spark, tmp_path):
    outer = C.Scratch(spark, "outer")
    outer.table(spark.range(1))
    with C.owned():
        a = C.Scratch(spark, "a")
        out = a.table(spark.range(3))
        with C.owned():
            b = C.Scratch(spark, "b")
            b.table(spark.range(1))
        assert there(spark, a) and not there(spark, b)
        out.write.parquet(f"{tmp_path}/kept")
    assert not there(spark, a) and there(spark, outer) and spark.read.parquet(f"{tmp_path}/kept").count() == 3
    outer.drop()


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(applicationId="elsewhere", master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        C.scratch_root(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default)))


def test_map_batches_slices(spark, monkeypatch):
    df = spark.createDataFrame([("x" * n,) for n in (1, 5, 0, 900, 3)] + [(None,)], "t string").coalesce(1)
    out = C.map_batches(df, "n long", lambda r: {"n": [len(r["t"])]}, "t")
    assert out.agg(F.sum("n")).first()[0] == 6
    assert isinstance(pa.schema([]), pa.Schema)
