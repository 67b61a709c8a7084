"""Array files as tables: against what was put in."""

import gzip
import itertools
import json
import struct
import zlib
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.sources import arrays, readers

RNG = np.random.default_rng(4)
TIME, LAT, LON = np.array([0, 6, 12, 18, 24]), np.array([10.0, 20.0, 30.0]), np.array([200.0, 210.0, 220.0, 230.0])
T2M = RNG.normal(280, 5, (5, 3, 4)).astype(np.float32)
PACKED = RNG.integers(-100, 100, (5, 3, 4)).astype(np.int16)
ATTRIBUTES = {"time": {"units": "hours since 2000-01-01T12:00:00"}, "t2m": {"_FillValue": -9999.0}, "count": {"scale_factor": 0.5, "add_offset": 10.0}}


@pytest.fixture(scope="module")
def held():
    x = T2M.copy()
    x[2, 1, 3] = -9999.0
    return x


def netcdf(path, held, growing=None, **more):
    at = {"time": (("time",), TIME.astype(np.int32)), "lat": (("lat",), LAT), "lon": (("lon",), LON)}
    values = {"t2m": (("time", "lat", "lon"), held), "count": (("time", "lat", "lon"), PACKED)}
    raw = arrays.encode_netcdf(at | values | more, ATTRIBUTES, {"title": "a test é"}, growing)
    Path(path).write_bytes(raw)
    return str(path)


def zarr(path, held, codec, squeeze, consolidated=False, absent=()):
    meta = {".zgroup": {"zarr_format": 2}, ".zattrs": {"title": "x"}}
    for name, dims, x, chunks in (("time", ["time"], TIME, [5]), ("lat", ["lat"], LAT, [2]), ("lon", ["lon"], LON, [4]), ("t2m", ["time", "lat", "lon"], held, [2, 2, 3]), ("count", ["time", "lat", "lon"], PACKED, [2, 2, 3])):
        folder = Path(path, name)
        folder.mkdir(parents=True)
        meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": list(x.shape), "chunks": chunks, "dtype": x.dtype.str, "compressor": codec, "fill_value": 0, "order": "C", "filters": None}
        meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims} | ATTRIBUTES.get(name, {})
        for index in itertools.product(*[range(-(-n // c)) for n, c in zip(x.shape, chunks)]):
            chunk = np.zeros(chunks, x.dtype)
            part = x[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks))]
            chunk[tuple(slice(0, n) for n in part.shape)] = part
            if (name, index) not in absent:
                Path(folder, ".".join(map(str, index))).write_bytes(squeeze(chunk.tobytes()))
    if consolidated:
        Path(path, ".zmetadata").write_text(json.dumps({"metadata": meta}))
    else:
        for k, v in meta.items():
            Path(path, k).write_text(json.dumps(v))
    return str(path)


def expected(held):
    out = {}
    for t, i, j in itertools.product(range(5), range(3), range(4)):
        x = held[t, i, j]
        out[int(TIME[t]), LAT[i], LON[j]] = (None if x == -9999 else float(x), PACKED[t, i, j] * 0.5 + 10)
    return out


def rows(df):
    return {(r["time"], r["lat"], r["lon"]): (r["t2m"], r["count"]) for r in df.collect()}


@pytest.mark.parametrize("growing", [None, "time"])
def test_netcdf(spark, tmp_path, held, growing, monkeypatch):
    arrays.register(spark)
    path = netcdf(tmp_path / "a.nc", held, growing)
    df = spark.read.format("netcdf").load(path)
    assert df.dtypes == [("time", "int"), ("lat", "double"), ("lon", "double"), ("t2m", "float"), ("count", "double")]
    assert rows(df) == expected(held)
    part = spark.read.format("netcdf").option("first", 1).option("last", 3).option("variables", "t2m").load(path)
    assert {k: v for k, (v, _) in expected(held).items() if k[0] in (6, 12)} == {(r["time"], r["lat"], r["lon"]): r["t2m"] for r in part.collect()}
    monkeypatch.setattr(arrays, "SLAB_VALUES", 12)
    assert len(arrays._ArrayReader(arrays.NetCDF, {"path": path}).partitions()) == 5
    timed = spark.read.format("netcdf").option("decode_times", "true").load(path)
    assert timed.agg(F.min("time"), F.max("time")).first()[:] == (datetime(2000, 1, 1, 12), datetime(2000, 1, 2, 12))
    one = spark.read.format("netcdf").option("variables", "lat").load(path)
    assert [r["lat"] for r in one.select(one.columns[-1]).collect()] == LAT.tolist()


def test_netcdf_versions_and_lone_record_variables(spark, tmp_path):
    # version 1 by hand: one record variable of three shorts a record, which are not padded
    text = lambda s: struct.pack(">i", len(s)) + s + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">i", 4) + struct.pack(">ii", 10, 2) + text(b"t") + struct.pack(">i", 0) + text(b"x") + struct.pack(">i", 3)
    head += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + text(b"v") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0)
    head += struct.pack(">iii", 3, 8, len(head) + 12)
    values = np.arange(12, dtype=">i2").reshape(4, 3)
    Path(tmp_path, "v1.nc").write_bytes(head + values.tobytes())
    arrays.register(spark)
    got = spark.read.format("netcdf").load(f"{tmp_path}/v1.nc")
    assert got.dtypes == [("t", "int"), ("x", "int"), ("v", "smallint")]
    assert {(r["t"], r["x"]): r["v"] for r in got.collect()} == {(t, x): 3 * t + x for t in range(4) for x in range(3)}


def test_other_files_are_errors(spark, tmp_path):
    Path(tmp_path, "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    Path(tmp_path, "x.nc").write_bytes(b"nothing of it")
    for name, what in (("h.nc", "HDF5"), ("x.nc", "no classic")):
        with pytest.raises(ValueError, match=what):
            arrays.NetCDF(f"{tmp_path}/{name}")


@pytest.mark.parametrize("codec,squeeze,consolidated", [(None, bytes, False), ({"id": "zlib", "level": 1}, zlib.compress, True), ({"id": "gzip", "level": 1}, gzip.compress, False)])
def test_zarr(spark, tmp_path, held, codec, squeeze, consolidated):
    arrays.register(spark)
    path = zarr(tmp_path / "s.zarr", held, codec, squeeze, consolidated)
    df = spark.read.format("zarr").load(path)
    assert rows(df) == expected(held)
    assert len(arrays._ArrayReader(arrays.Zarr, {"path": path}).partitions()) == 3 * 2 * 2
    part = spark.read.format("zarr").option("first", 1).option("last", 4).load(path)
    assert rows(part) == {k: v for k, v in expected(held).items() if k[0] in (6, 12, 18)}
    assert readers.read_grid(spark, path, format=readers.format_of(path)).columns == ["time", "lat", "lon", "time_idx", "value"]


def test_absent_chunks_and_codecs(spark, tmp_path, held):
    path = zarr(tmp_path / "a.zarr", held, None, bytes, absent={("t2m", (0, 0, 0))})
    block = arrays.Zarr(path).slab("t2m", 0, 2)
    assert (block[:, :2, :3] == 0).all() and (block[:, 2] == held[:2, 2]).all()
    path = zarr(tmp_path / "b.zarr", held, {"id": "unheard-of"}, bytes)
    with pytest.raises(ValueError, match="unheard-of"):
        arrays.Zarr(path).slab("t2m")


class Counting:
    """The bytes that are read of each file below a folder."""

    def __init__(self, monkeypatch):
        self.read, self.files = 0, set()
        real = arrays._store
        count = self

        class File:
            def __init__(self, f, at):
                self.f, self.at = f, at

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.f.close()

            def seek(self, n):
                self.f.seek(n)

            def read(self, *n):
                raw = self.f.read(*n)
                count.read += len(raw)
                count.files.add(self.at.rpartition("/")[2])
                return raw

        class Store:
            def __init__(self, store):
                self.store = store

            def open_input_file(self, at):
                return File(self.store.open_input_file(at), at)

            def __getattr__(self, name):
                return getattr(self.store, name)

        def store(path):
            held, at = real(path)
            return Store(held), at

        monkeypatch.setattr(arrays, "_store", store)


def read_rows(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_ranges_choose_chunks(tmp_path, held, monkeypatch):
    path = zarr(tmp_path / "s.zarr", held, None, bytes)
    ranges = lambda **r: arrays._ArrayReader(arrays.Zarr, {"path": path, "variables": "t2m", "ranges": json.dumps(r)})
    reader = ranges(time=[[6, 11]], lat=[[25.0, None]], lon=[[None, 210.0]])
    counting = Counting(monkeypatch)
    got = read_rows(reader)
    assert [(r["time"], r["lat"], r["lon"]) for r in got] == [(6, 30.0, 200.0), (6, 30.0, 210.0)]
    assert {f for f in counting.files if "." in f and not f.startswith(".")} == {"0.1.0"}
    assert ranges(time=[[7, 8]]).partitions() == []
    # runs of the leading axis are read one by one
    assert {r["time"] for r in read_rows(ranges(time=[[0, 1], [24, 30]]))} == {0, 24}


def test_ranges_choose_byte_ranges(tmp_path, monkeypatch):
    x = np.arange(20 * 30 * 40, dtype=np.float32).reshape(20, 30, 40)
    at = {"time": (("time",), np.arange(20.0)), "lat": (("lat",), np.arange(30.0)), "lon": (("lon",), np.arange(40.0))}
    Path(tmp_path, "a.nc").write_bytes(arrays.encode_netcdf(at | {"v": (("time", "lat", "lon"), x)}, {}, {}))
    Path(tmp_path, "g.nc").write_bytes(arrays.encode_netcdf(at | {"v": (("time", "lat", "lon"), x)}, {}, {}, "time"))
    ranges = json.dumps({"time": [[4.5, 6]], "lat": [[7, 7]], "lon": [[None, 2]]})
    for name in ("a.nc", "g.nc"):
        for short in (1, 10**6):
            monkeypatch.setattr(arrays, "SHORT_RUN", short)
            reader = arrays._ArrayReader(arrays.NetCDF, {"path": f"{tmp_path}/{name}", "ranges": ranges})
            with monkeypatch.context() as m:
                counting = Counting(m)
                got = read_rows(reader)
            assert [r["v"] for r in got] == x[5:7, 7, :3].reshape(-1).tolist()
            assert counting.read < (3000 if short == 1 else 12000)


def test_ranges_of_times(spark, tmp_path, held):
    path = zarr(tmp_path / "s.zarr", held, None, bytes)
    timed = lambda **r: arrays.load(spark, "zarr", path, r, decode_times="true", variables="t2m")
    got = timed(time=[("2000-01-01 18:00:00", "2000-01-01 23:59:59")], lat=[(10.0, 10.0)])
    assert {(r["time"], r["lon"]) for r in got.collect()} == {(datetime(2000, 1, 1, 18), x) for x in LON.tolist()}
    assert got.rdd.getNumPartitions() == 2 < timed().rdd.getNumPartitions() == 12
    some = timed(time=[("2000-01-01T12:00:00", "2000-01-01T13:00:00"), ("2000-01-02T12:00:00", None)])
    assert {r["time"] for r in some.select("time").distinct().collect()} == {datetime(2000, 1, 1, 12), datetime(2000, 1, 2, 12)}
    # tables of different ranges do not meet
    assert timed().count() == 60 and got.count() == 4


def member_files(folder, years=(1980, 1981), members=25):
    at = {"sample": (("sample",), np.zeros(1)), "lat": (("lat",), LAT), "lon": (("lon",), LON)}
    for year in years:
        for k in range(members):
            values = np.full((1, 4, 3, 4), year + k / 100, np.float32)
            raw = arrays.encode_netcdf(at | {"time": (("time",), np.arange(1, 5) * 21600.0 * 10**6), "TMP2m": (("sample", "time", "lat", "lon"), values)}, {"time": {"units": "microseconds"}, "TMP2m": {"units": "K"}}, {})
            name = Path(folder, str(year), f"member_{k:02d}", "out.nc")
            name.parent.mkdir(parents=True)
            name.write_bytes(raw)


def test_many_files_are_one_table(spark, tmp_path):
    arrays.register(spark)
    member_files(tmp_path)
    source = spark.read.format("netcdf").option("name_pattern", r"(?P<year>\d{4})/member_(?P<member>\d+)/").option("with_index", "time")
    df = source.load(f"{tmp_path}/*/member_*/out.nc")
    assert df.dtypes[:2] == [("year", "bigint"), ("member", "bigint")] and "time_idx" in df.columns
    assert df.rdd.getNumPartitions() == 50 and df.count() == 50 * 4 * 12
    assert df.schema["time"].metadata == {"units": "microseconds"} and df.schema["TMP2m"].metadata == {"units": "K"}
    plan = df._jdf.queryExecution().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan
    told = {"name_pattern": r"(?P<year>\d{4})/member_(?P<member>\d+)/", "with_index": "time"}
    one = arrays.load(spark, "netcdf", f"{tmp_path}/*/member_*/out.nc", {"year": [(1981, None)], "member": [(3, 4)]}, **told).where("time_idx = 2")
    assert one.rdd.getNumPartitions() == 2
    assert {(r["year"], r["member"], round(r["TMP2m"], 2), r["time_idx"]) for r in one.collect()} == {(1981, 3, 1981.03, 2), (1981, 4, 1981.04, 2)}
    listed = source.load([f"{tmp_path}/1980/member_00/out.nc", f"{tmp_path}/1981/*/out.nc"])
    assert listed.select("year", "member").distinct().count() == 26
    with pytest.raises(Exception, match="no files"):
        source.load(f"{tmp_path}/*/nothing_*").count()


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    arrays.register(spark)
    member_files(tmp_path, (1980,), 6)
    file = lambda k: Path(tmp_path, "1980", f"member_{k:02d}", "out.nc")
    file(0).write_bytes(b"")
    file(2).write_bytes(file(2).read_bytes()[:-100])
    other = {"sample": (("sample",), np.zeros(1)), "lat": (("lat",), LAT + 1), "lon": (("lon",), LON), "time": (("time",), np.arange(4.0))}
    file(4).write_bytes(arrays.encode_netcdf(other | {"TMP2m": (("sample", "time", "lat", "lon"), np.zeros((1, 4, 3, 4), np.float32))}, {}, {}))
    source = spark.read.format("netcdf").option("name_pattern", r"member_(?P<member>\d+)")
    df = source.option("on_error", "row").load(f"{tmp_path}/*/*/out.nc")
    failed = {r["member"]: r["error"] for r in df.where("error is not null").collect()}
    assert set(failed) == {0, 2, 4} and "ends before" in failed[2] and "axes" in failed[4]
    assert df.where("error is null and TMP2m is not null").select("member").distinct().count() == 3
    file(0).unlink()
    with pytest.raises(Exception, match="axes|ends before"):
        source.option("on_error", "fail").load(f"{tmp_path}/*/member_*/out.nc").count()


def test_tables_become_stores_and_come_back(spark, tmp_path):
    cells = [(datetime(2000, 1, d), 10.0 * i, 5.0 * j, float(d + i * j), None if i == j else i) for d in (1, 2, 5) for i in range(3) for j in range(4) if (i, j) != (2, 1)]
    df = spark.createDataFrame(cells, "time timestamp_ntz, lat double, lon double, a double, b int").withMetadata("a", {"units": "degC"}).repartition(5)
    for chunks in ({"time": 2, "lat": 2, "lon": 3}, {}):
        arrays.write_zarr(df, f"{tmp_path}/w.zarr", ["time", "lat", "lon"], ["a", "b"], chunks, {"title": "t"})
        assert [p.name for p in Path(tmp_path).iterdir()] == ["w.zarr"]
        source = arrays.Zarr(f"{tmp_path}/w.zarr")
        assert source.variables["a"].attributes["units"] == "degC" and source.attributes == {"title": "t"}
        back = spark.read.format("zarr").option("decode_times", "true").load(f"{tmp_path}/w.zarr").where("a is not null")
        assert sorted((r["time"], r["lat"], r["lon"], r["a"], r["b"]) for r in back.collect()) == sorted((*c[:4], c[4]) for c in cells) or chunks is None
    few = df.where("lat < 10")
    arrays.write_zarr(few, f"{tmp_path}/few.zarr", ["time", "lat", "lon"], ["a"], {"lon": 1})
    assert spark.read.format("zarr").load(f"{tmp_path}/few.zarr").where("a is not null").count() == few.count()


def test_a_failed_write_leaves_no_store(spark, tmp_path):
    df = spark.range(40).selectExpr("id div 8 as a", "id % 8 as b", "if(id = 39, cast(raise_error('no value') as double), 1.0D) as v")
    with pytest.raises(Exception, match="no value"):
        arrays.write_zarr(df, f"{tmp_path}/x.zarr", ["a", "b"], ["v"], {"a": 1})
    assert list(Path(tmp_path).iterdir()) == []
