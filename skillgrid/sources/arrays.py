"""Array files (NetCDF classic, Zarr version 2) as long tables, and tables as Zarr stores.

Both are data sources of Spark: register(spark), then
spark.read.format("netcdf" | "zarr").option("variables", "a,b").load(path). A table has a
column for each dimension of the variables, which must share them (the values of its
coordinate variable, or the index where there is none), and one for each variable; units and
other attributes are the metadata of the columns. Options:

* variables: names, by default all that have the most dimensions; no others are read,
* first, last: a range of the leading index (last excluded), so that no more is read,
* ranges: JSON of a list of [from, to] for dimensions or groups (both ends included, null is
  open, times as text); rows outside of all of a list's ranges are not read,
* decode_times: true turns coordinates with units "hours since ..." into timestamps,
* with_index: dimensions that also give a column <name>_idx, the place along the axis,
* name_pattern: a regular expression with named groups, found in each file's path; each
  group is a column (a whole number if the first file's is), as for members and years; it
  takes the place of a dimension of its name, which must have a single place,
* on_error: "row" makes a file that cannot be read a row with its path as `file` and the
  reason as `error`, instead of an error of the query; other rows have a NULL `error`.

A path may have * in it (or be a list): many files are one table, a partition for each, read
slab by slab; all must have the first one's variables and axes other than the leading one, else
they are unreadable. load() takes ranges of values: they become ranges of indices by the
coordinates' values, and ranges of a group of the path choose files, so that only the chunks and
byte ranges in question are read. Ranges are options and not filters that Spark pushes, as
Spark 4.1 keeps the filters that one query pushed to a Python source for the next query on
the same table.

Packed values are unpacked (scale_factor, add_offset); fill values become NULL. Partitions
are runs of the leading index in NetCDF and chunks in Zarr: none reads more than its own
bytes, whatever the size of the store. Paths are those of pyarrow (file, s3, gs, hdfs; a
store's own settings go into the address). Files that are HDF5 inside, and chunks of codecs
that are not installed, are errors that say so.

write.format("zarr").option("dims", "time,lat,lon") writes a table: see ZarrWriter.
"""

from __future__ import annotations

import bz2
import itertools
import json
import lzma
import math
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

#: Values of a partition of a NetCDF file, about; shorter runs than SHORT_RUN bytes are read with what is between them.
SLAB_VALUES, SHORT_RUN = 4_000_000, 32_768
_TYPES_OF = {
    "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "bigint": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "string": T.StringType(),
}
_MICROS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}



@dataclass
class Variable:
    """Where the values of an array are, and what they mean."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: np.dtype
    attributes: dict[str, Any] = field(default_factory=dict)
    place: dict[str, Any] = field(default_factory=dict)

    def unpacked(self, x: np.ndarray) -> pa.Array:
        """Values in native order, scaled, with fill values as NULL."""
        x = x.reshape(-1)
        fills = [self.attributes[k] for k in ("_FillValue", "missing_value") if self.attributes.get(k) is not None]
        mask = np.zeros(len(x), bool)
        for fill in fills:
            fill = float("nan") if fill == "NaN" else fill
            mask |= np.isnan(x) if isinstance(fill, float) and math.isnan(fill) else x == fill
        if self.packed:
            x = x * float(self.attributes.get("scale_factor", 1.0)) + float(self.attributes.get("add_offset", 0.0))
        return pa.array(np.ascontiguousarray(x, x.dtype.newbyteorder("=")), mask=mask if mask.any() else None)

    @property
    def packed(self) -> bool:
        return "scale_factor" in self.attributes or "add_offset" in self.attributes

    @property
    def sql_type(self) -> str:
        if self.packed:
            return "double"
        kind = self.dtype
        if kind.kind == "u":
            kind = np.dtype(f"i{min(8, 2 * kind.itemsize)}")
        names = {("i", 1): "byte", ("i", 2): "short", ("i", 4): "int", ("i", 8): "long", ("f", 4): "float", ("f", 8): "double"}
        if (kind.kind, kind.itemsize) not in names:
            raise ValueError(f"values of type {self.dtype} are no numbers")
        return names[kind.kind, kind.itemsize]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), str(Path(path.removeprefix("file:")).absolute())


# --- NetCDF classic ------------------------------------------------------------------------

# Type numbers of the classic format, and the tags of its lists.
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12


class NetCDF:
    """The header of a classic file (versions 1, 2 and 5), and slabs of its variables."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.store, self.at = _store(path)
        with self.store.open_input_file(self.at) as f:
            head = f.read(4)
            if head[:3] != b"CDF" or head[3] not in (1, 2, 5):
                kind = "an HDF5 file, for which no library is here" if head == b"\x89HDF" else "no classic NetCDF file"
                raise ValueError(f"{path} is {kind}")
            self._wide, self._count = head[3] >= 2, ">q" if head[3] == 5 else ">i"
            self._f = f
            self.records = max(0, self._number())
            dims = [(self._name(), self._number()) for _ in range(self._list(_DIMENSIONS))]
            self.attributes = self._attributes()
            found = [self._variable(dims) for _ in range(self._list(_VARIABLES))]
            del self._f
        growing = [v for _, v in found if v.place["record"]]
        # a lone record variable is not padded
        self.stride = growing[0].place["own"] if len(growing) == 1 else sum(v.place["padded"] for v in growing)
        self.variables = dict(found)

    def _read(self, shape: str) -> int:
        return struct.unpack(shape, self._f.read(struct.calcsize(shape)))[0]

    def _number(self) -> int:
        return self._read(self._count)

    def _list(self, tag: int) -> int:
        kind, n = self._read(">i"), self._number()
        if kind not in (0, tag):
            raise ValueError(f"{self.path}: broken header")
        return n

    def _padded(self, n: int) -> bytes:
        return self._f.read(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._number()).decode("utf-8")

    def _attributes(self) -> dict[str, Any]:
        out = {}
        for _ in range(self._list(_ATTRIBUTES)):
            name, kind, n = self._name(), self._read(">i"), self._number()
            raw = self._padded(n * np.dtype(_TYPES[kind]).itemsize)
            values = np.frombuffer(raw, _TYPES[kind])
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else values[0].item() if n == 1 else values.tolist()
        return out

    def _variable(self, dims: list[tuple[str, int]]) -> tuple[str, Variable]:
        name = self._name()
        ids = [self._number() for _ in range(self._number())]
        attributes, kind = self._attributes(), np.dtype(_TYPES[self._read(">i")])
        self._number()  # the size that the header states may be cut off; it follows from the shape
        begin = self._read(">q" if self._wide else ">i")
        record = bool(ids) and dims[ids[0]][1] == 0
        shape = tuple(self.records if dims[i][1] == 0 else dims[i][1] for i in ids)
        own = math.prod(shape[1:] if record else shape) * kind.itemsize
        place = {"begin": begin, "record": record, "own": own, "padded": -(-own // 4) * 4}
        return name, Variable(tuple(dims[i][0] for i in ids), shape, kind, attributes, place)

    def slab(self, name: str, first: int | None = None, last: int | None = None) -> np.ndarray:
        """Values with a leading index of first..last-1 (all by default)."""
        v = self.variables[name]
        if not v.shape:
            first, last = 0, 1
        n = v.shape[0] if v.shape else 1
        first, last = max(0, first or 0), n if last is None else min(n, last)
        count, inner = max(0, last - first), v.shape[1:]
        with self.store.open_input_file(self.at) as f:
            if v.place["record"]:
                parts = []
                for i in range(first, first + count):
                    f.seek(v.place["begin"] + i * self.stride)
                    parts.append(_whole(f, v.place["own"]))
                raw = b"".join(parts)
            else:
                row = v.place["own"] // max(1, n)
                f.seek(v.place["begin"] + first * row)
                raw = _whole(f, count * row)
        return np.frombuffer(raw, v.dtype).reshape((count, *inner) if v.shape else ())

    def parts(self, names: list[str], box: list[tuple[int, int]]) -> list[dict]:
        """Runs of the leading index within a box, of about SLAB_VALUES values each."""
        (first, last), inner = box[0], box[1:]
        step = max(1, SLAB_VALUES // max(1, math.prod(b - a for a, b in inner)))
        return [{"begin": [i, *(a for a, _ in inner)], "end": [min(i + step, last), *(b for _, b in inner)]} for i in range(first, last, step)]

    def block(self, name: str, part: dict) -> np.ndarray:
        """The values of a box. Runs of bytes end with the last axis that is cut, unless that
        makes them short."""
        v, begin, end = self.variables[name], part["begin"], part["end"]
        size, stride = v.dtype.itemsize, [math.prod(v.shape[i + 1 :]) for i in range(len(v.shape))]
        cut = max([i for i, n in enumerate(v.shape) if end[i] - begin[i] < n], default=0)
        while cut and (end[cut] - begin[cut]) * stride[cut] * size < SHORT_RUN:
            cut -= 1
        if cut == 0:
            out = self.slab(name, begin[0], end[0])
        else:
            row = self.stride if v.place["record"] else stride[0] * size
            length = (end[cut] - begin[cut]) * stride[cut] * size
            raw = []
            with self.store.open_input_file(self.at) as f:
                for index in itertools.product(*[range(a, b) for a, b in zip(begin[:cut], end[:cut])]):
                    place = sum(i * n for i, n in zip(index[1:], stride[1:cut])) + begin[cut] * stride[cut]
                    f.seek(v.place["begin"] + index[0] * row + place * size)
                    raw.append(_whole(f, length))
            out = np.frombuffer(b"".join(raw), v.dtype).reshape([*(b - a for a, b in zip(begin[: cut + 1], end)), *v.shape[cut + 1 :]])
        return out[tuple(slice(None) if i <= cut else slice(a, b) for i, (a, b) in enumerate(zip(begin, end)))]


def _whole(f: Any, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError("the file ends before its values do")
    return raw


def encode_netcdf(arrays: dict[str, tuple[tuple[str, ...], np.ndarray]], attributes: dict[str, dict[str, Any]], of_file: dict[str, Any], growing: str | None = None) -> bytes:
    """A classic file with 64-bit offsets. `growing` names the record dimension, if any,
    which must lead the variables that have it."""
    number = {v: k for k, v in _TYPES.items()}
    kinds = {}
    for name, (_, x) in arrays.items():
        kind = {"i8": ">f8", "u8": ">f8"}.get(x.dtype.str[1:], x.dtype.newbyteorder(">").str.replace("|", ""))
        kinds[name] = np.dtype(kind)
    sizes: dict[str, int] = {}
    for dims, x in arrays.values():
        sizes |= dict(zip(dims, x.shape))
    order = list(sizes)
    pad = lambda raw: raw + b"\0" * (-len(raw) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def told(values: dict[str, Any]) -> bytes:
        out = []
        for k, v in values.items():
            if isinstance(v, str):
                out.append(text(k) + struct.pack(">ii", 2, len(v.encode())) + pad(v.encode()))
            else:
                out.append(text(k) + struct.pack(">iid", 6, 1, float(v)))
        return listed(_ATTRIBUTES, out)

    records = sizes.get(growing, 0) if growing else 0
    inner = {n: math.prod(s for d, s in zip(dims, x.shape) if d != growing) * kinds[n].itemsize for n, (dims, x) in arrays.items()}
    moving = [n for n, (dims, _) in arrays.items() if growing in dims]
    padded = {n: inner[n] if moving == [n] else -(-inner[n] // 4) * 4 for n in arrays}

    def header(begins: dict[str, int]) -> bytes:
        dims = listed(_DIMENSIONS, [text(d) + struct.pack(">i", 0 if d == growing else sizes[d]) for d in order])
        items = []
        for name, (own, _) in arrays.items():
            ids = struct.pack(f">i{len(own)}i", len(own), *[order.index(d) for d in own])
            kind = number[kinds[name].str.replace("|", "")]
            items.append(text(name) + ids + told(attributes.get(name, {})) + struct.pack(">iiq", kind, min(padded[name], 2**31 - 1), begins[name]))
        return b"CDF\x02" + struct.pack(">i", records) + dims + told(of_file) + listed(_VARIABLES, items)

    at = len(header(dict.fromkeys(arrays, 0)))
    begins = {}
    for name in [*(n for n in arrays if n not in moving), *moving]:
        begins[name], at = at, at + padded[name]
    out = [header(begins)]
    out += [pad(np.ascontiguousarray(arrays[n][1], kinds[n]).tobytes()) for n in arrays if n not in moving]
    for i in range(records):
        for n in moving:
            raw = np.ascontiguousarray(arrays[n][1][i], kinds[n]).tobytes()
            out.append(raw + b"\0" * (padded[n] - len(raw)))
    return b"".join(out)


# --- Zarr ----------------------------------------------------------------------------------


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def _other(codec: dict, raw: bytes) -> bytes:
    try:
        import numcodecs
    except ModuleNotFoundError:
        raise ValueError(f"no library for the codec {codec['id']}") from None
    return bytes(numcodecs.get_codec(codec).decode(raw))


_CODECS = {"zlib": zlib.decompress, "gzip": lambda raw: zlib.decompress(raw, 47), "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": _zstd}


class Zarr:
    """The arrays of a group of version 2, by chunk."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.store, self.at = _store(self.path)
        whole = self._json(".zmetadata")
        if whole is not None:
            meta = whole["metadata"]
        else:
            found = self.store.get_file_info(pafs.FileSelector(self.at))
            meta = {}
            for name in sorted(x.base_name for x in found if x.type == pafs.FileType.Directory):
                for part in (".zarray", ".zattrs"):
                    meta[f"{name}/{part}"] = self._json(f"{name}/{part}")
            meta[".zattrs"] = self._json(".zattrs")
        self.attributes = meta.get(".zattrs") or {}
        self.variables = {}
        for key in [k for k, v in meta.items() if k.endswith("/.zarray") and v is not None]:
            name, array = key.rsplit("/", 1)[0], meta[key]
            attributes = dict(meta.get(f"{name}/.zattrs") or {})
            dims = tuple(attributes.pop("_ARRAY_DIMENSIONS", [f"dim_{i}" for i in range(len(array["shape"]))]))
            if array.get("filters") or array["zarr_format"] != 2:
                raise ValueError(f"{self.path}/{name}: filters and later versions are not read")
            if array["fill_value"] is not None and np.dtype(array["dtype"]).kind == "f":
                attributes.setdefault("_FillValue", array["fill_value"])
            self.variables[name] = Variable(dims, tuple(array["shape"]), np.dtype(array["dtype"]), attributes, array)

    def _bytes(self, name: str) -> bytes | None:
        info = self.store.get_file_info(f"{self.at}/{name}")
        if info.type != pafs.FileType.File:
            return None
        with self.store.open_input_file(info.path) as f:
            return f.read()

    def _json(self, name: str) -> dict | None:
        raw = self._bytes(name)
        return None if raw is None else json.loads(raw)

    def _chunk(self, name: str, index: tuple[int, ...]) -> np.ndarray:
        array = self.variables[name].place
        raw = self._bytes(f"{name}/{array.get('dimension_separator', '.').join(map(str, index or (0,)))}")
        if raw is None:  # chunks that are not there hold the fill value
            return np.full(array["chunks"], array["fill_value"] or 0, np.dtype(array["dtype"]))
        codec = array["compressor"]
        if codec is not None:
            raw = _CODECS[codec["id"]](raw) if codec["id"] in _CODECS else _other(codec, raw)
        return np.frombuffer(raw, np.dtype(array["dtype"])).reshape(array["chunks"], order=array["order"])

    def block(self, name: str, part: dict) -> np.ndarray:
        """The values of a box, from the chunks that it touches."""
        chunks = self.variables[name].place["chunks"]
        begin, end = part["begin"], part["end"]
        out = np.empty([b - a for a, b in zip(begin, end)], self.variables[name].dtype)
        touched = [range(a // c, -(-b // c)) for a, b, c in zip(begin, end, chunks)]
        for index in itertools.product(*touched):
            low = [max(a, i * c) for a, i, c in zip(begin, index, chunks)]
            high = [min(b, (i + 1) * c) for b, i, c in zip(end, index, chunks)]
            held = self._chunk(name, index)[tuple(slice(a - i * c, b - i * c) for a, b, i, c in zip(low, high, index, chunks))]
            out[tuple(slice(a - o, b - o) for a, b, o in zip(low, high, begin))] = held
        return out

    def slab(self, name: str, first: int | None = None, last: int | None = None) -> np.ndarray:
        shape = self.variables[name].shape
        begin = [first or 0, *[0] * (len(shape) - 1)][: len(shape)]
        return self.block(name, {"begin": begin, "end": [min(last or shape[0], shape[0]), *shape[1:]] if shape else []})

    def parts(self, names: list[str], box: list[tuple[int, int]]) -> list[dict]:
        """The parts of chunks that lie within a box."""
        chunks = self.variables[names[0]].place["chunks"]
        cuts = [[(max(a, lo), min(a + c, hi)) for a in range(lo // c * c, hi, c)] for c, (lo, hi) in zip(chunks, box)]
        return [{"begin": [a for a, _ in one], "end": [b for _, b in one]} for one in itertools.product(*cuts)]


# --- writing a store -----------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    chunks: int


class ZarrWriter(DataSourceArrowWriter):
    """A table as a Zarr store, a chunk for each task's group of rows: write_zarr() deals the
    rows so that each chunk's are in one task. Chunks go into the folder <path>.tmp; the commit
    writes axes and metadata and gives the folder its name, so that readers see all of it or
    nothing, and a failed job leaves no store. A repeated task writes the same chunks again."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.meta = options["path"].rstrip("/"), json.loads(options["layout"])
        self.names = [f.name for f in schema.fields]
        self.tmp = f"{self.path}.tmp"

    def _put(self, name: str, raw: bytes) -> None:
        store, at = _store(f"{self.tmp}/{name}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as f:
            f.write(raw)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        dims, chunks, variables = self.meta["dims"], self.meta["chunks"], self.meta["variables"]
        held: dict[tuple[int, ...], dict[str, np.ndarray]] = {}
        n = 0
        for batch in iterator:
            column = lambda name: batch.column(self.names.index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            place = np.stack([column(f"_{d}").astype(np.int64) for d in dims], 1)
            index, inner = place // chunks, place % chunks
            which, row = np.unique(index, axis=0, return_inverse=True)
            for i, one in enumerate(map(tuple, which.tolist())):
                if one not in held:  # rows come chunk by chunk
                    n += self._chunk(held)
                rows = row.reshape(-1) == i
                mine = held.setdefault(one, {v: np.full(chunks, np.nan, t) for v, t in variables.items()})
                for v in variables:
                    mine[v][tuple(inner[rows].T)] = column(v)[rows]
        return _Written(n + self._chunk(held))

    def _chunk(self, held: dict[tuple[int, ...], dict[str, np.ndarray]]) -> int:
        n = len(held)
        for index, values in held.items():
            for v, x in values.items():
                self._put(f"{v}/{'.'.join(map(str, index))}", zlib.compress(x.tobytes(), 1))
        held.clear()
        return n

    def commit(self, messages: list[_Written | None]) -> None:
        whole = {".zgroup": {"zarr_format": 2}, ".zattrs": self.meta["attributes"]}
        array = {"zarr_format": 2, "compressor": {"id": "zlib", "level": 1}, "order": "C", "filters": None}
        for d, axis in self.meta["axes"].items():
            x = np.array(axis["values"], axis["dtype"])
            self._put(f"{d}/0", zlib.compress(x.tobytes(), 1))
            whole[f"{d}/.zarray"] = array | {"shape": [len(x)], "chunks": [max(1, len(x))], "dtype": x.dtype.str, "fill_value": None}
            whole[f"{d}/.zattrs"] = {"_ARRAY_DIMENSIONS": [d]} | axis["attributes"]
        for v, kind in self.meta["variables"].items():
            shape = [len(self.meta["axes"][d]["values"]) for d in self.meta["dims"]]
            whole[f"{v}/.zarray"] = array | {"shape": shape, "chunks": self.meta["chunks"], "dtype": kind, "fill_value": "NaN"}
            whole[f"{v}/.zattrs"] = {"_ARRAY_DIMENSIONS": self.meta["dims"]} | self.meta["told"].get(v, {})
        for name, value in whole.items():
            self._put(name, json.dumps(value).encode())
        self._put(".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": whole}).encode())
        store, at = _store(self.path)
        if store.get_file_info(at).type == pafs.FileType.Directory:
            store.delete_dir(at)
        store.move(f"{at}.tmp", at)

    def abort(self, messages: list[_Written | None]) -> None:
        store, at = _store(self.tmp)
        if store.get_file_info(at).type == pafs.FileType.Directory:
            store.delete_dir(at)


#: Distinct values of an axis that a store may have: they are read to the driver and written as one array.
MOST_AXIS = 2_000_000


def write_zarr(df: DataFrame, path: str, dims: list[str], variables: list[str], chunks: dict[str, int] | None = None, attributes: dict[str, str] | None = None) -> None:
    """A grid as a Zarr store that tasks write chunk by chunk. Dimensions are the sorted
    distinct values of their columns (timestamps as hours since 1970); cells without a row
    are NaN, of repeated cells one row is kept. Attributes of columns go with them. Only
    the axes come to the driver; one of more than MOST_AXIS values is an error."""
    from pyspark.sql import functions as F

    spark, axes = df.sparkSession, {}
    register(spark)
    kinds = {v: "float" if df.schema[v].dataType.typeName() == "float" else "double" for v in variables}
    rows = df.select(*dims, *[F.col(v).cast(kind).alias(v) for v, kind in kinds.items()])
    chunk = [max(1, (chunks or {}).get(d, 64)) for d in dims]
    for d in dims:
        values = rows.select(d).where(F.col(d).isNotNull()).distinct().orderBy(d).limit(MOST_AXIS + 1).toArrow().column(0).combine_chunks()
        if len(values) > MOST_AXIS:
            raise ValueError(f"the axis {d} has over {MOST_AXIS} values")
        told = dict(df.schema[d].metadata)
        place = spark.createDataFrame(pa.table({d: values, f"_{d}": pa.array(np.arange(len(values), dtype=np.int64))}))
        rows = rows.join(F.broadcast(place) if len(values) <= 100_000 else place, d)
        numbers = values.to_numpy(zero_copy_only=False)
        if pa.types.is_timestamp(values.type) or pa.types.is_date(values.type):
            numbers = values.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() / 3_600_000_000
            told["units"] = "hours since 1970-01-01T00:00:00"
        axes[d] = {"values": numbers.tolist(), "dtype": numbers.dtype.str, "attributes": told}
    layout = {
        "dims": dims, "chunks": chunk, "variables": {v: "<f4" if k == "float" else "<f8" for v, k in kinds.items()}, "axes": axes,
        "attributes": attributes or {}, "told": {v: dict(df.schema[v].metadata) for v in variables},
    }
    keys = [f"_c{d}" for d in dims]
    of_chunk = [F.floor(F.col(f"_{d}") / c).alias(k) for d, c, k in zip(dims, chunk, keys)]
    rows = rows.dropDuplicates([f"_{d}" for d in dims]).select(*[f"_{d}" for d in dims], *variables, *of_chunk)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys).drop(*keys)
    rows.write.format("zarr").option("layout", json.dumps(layout)).mode("append").save(path)


# --- the data sources ----------------------------------------------------------------------


def _since(units: str) -> tuple[int, np.datetime64] | None:
    unit, _, reference = units.partition(" since ")
    unit = unit.strip().lower().rstrip("s")
    if unit not in _MICROS or not reference:
        return None
    return _MICROS[unit], np.datetime64(reference.strip().removesuffix("Z").replace(" ", "T", 1).split(" ")[0], "us")


def expand(path: str) -> list[str]:
    """The files of a path, in order: a JSON list of paths, or a name with * in some of its parts."""
    if path.startswith("["):
        return sorted(x for one in json.loads(path) for x in expand(one))
    if "*" not in path:
        return [path]
    store, at = _store(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    fixed = at.split("*")[0].rpartition("/")[0]
    wanted = re.compile("[^/]*".join(map(re.escape, at.split("*"))) + "/?")
    found = store.get_file_info(pafs.FileSelector(fixed, recursive=True, allow_not_found=True))
    out = sorted(head + x.path for x in found if wanted.fullmatch(x.path))
    if not out:
        raise FileNotFoundError(f"no files for {path}")
    return out


def file_sizes(files: list[str]) -> list[tuple[str, int, str]]:
    """Path, size and time of change of each file."""
    out = []
    for file in files:
        store, at = _store(file)
        info = store.get_file_info(at)
        out.append((file, info.size or 0, str(info.mtime_ns)))
    return out


Ranges = dict[str, list[tuple[Any, Any]]]


def _passing(values: np.ndarray, ranges: list[tuple[Any, Any]]) -> np.ndarray:
    """Which values lie in one of the ranges; missing ones do not."""
    kind = (lambda x: np.datetime64(x, "us")) if values.dtype.kind == "M" else float
    out = np.zeros(len(values), bool)
    for low, high in ranges:
        out |= (True if low is None else values >= kind(low)) & (True if high is None else values <= kind(high)) & (values == values)
    return out


class _Part(InputPartition):
    """A file, and a box of it (None: all that is asked for)."""

    def __init__(self, file: str, box: dict | None) -> None:
        super().__init__(file)
        self.file, self.box = file, box


class _ArrayReader(DataSourceReader):
    def __init__(self, opener: type, options: dict[str, str]) -> None:
        if "path" not in options and "paths" not in options:
            raise ValueError("a path is needed")
        listed = lambda name: [x.strip() for x in options.get(name, "").split(",") if x.strip()]
        self.opener, self.files = opener, expand(options.get("paths") or options["path"])
        self.decode = options.get("decode_times", "false").lower() == "true"
        self.tolerant = options.get("on_error", "fail") == "row"
        self.pattern = re.compile(options["name_pattern"]) if "name_pattern" in options else None
        self.range = int(options.get("first", 0)), int(options["last"]) if "last" in options else None
        self.ranges: Ranges = json.loads(options.get("ranges", "{}"))
        source, self.first_file = self._first()
        named = listed("variables")
        if absent := [x for x in named if x not in source.variables]:
            raise KeyError(f"no variables {absent} in {sorted(source.variables)}")
        if not named:
            most = max(len(v.dims) for v in source.variables.values())
            named = [n for n, v in source.variables.items() if len(v.dims) == most and v.dims != (n,)]
        self.dims = source.variables[named[0]].dims
        if any(source.variables[n].dims != self.dims for n in named):
            raise ValueError(f"variables {named} do not share their dimensions")
        self.names = [n for n in named if n not in self.dims]  # a coordinate is a column already
        self.indexed = [d for d in listed("with_index") if d in self.dims]
        self.kinds = {n: source.variables[n].sql_type for n in self.names} | {d: self._axis_type(source, d) for d in self.dims}
        self.inner = self._inner(source)
        fields = [(n, "bigint" if number else "string", {}) for n, number in self._groups(self.first_file).items()]
        if long := [d for d, n in zip(self.dims, source.variables[named[0]].shape) if d in self._groups(self.first_file) and n != 1]:
            raise ValueError(f"groups of the path and dimensions of more than one place: {long}")
        fields += [(d, self.kinds[d], self._told(source, d)) for d in self.dims if d not in self._groups(self.first_file)] + [(f"{d}_idx", "int", {}) for d in self.indexed]
        fields += [(n, self.kinds[n], self._told(source, n)) for n in self.names]
        fields += [("file", "string", {}), ("error", "string", {})] if self.tolerant else []
        self.schema = StructType([StructField(n, _TYPES_OF[kind], True, told) for n, kind, told in fields])

    def _first(self) -> tuple[Any, str]:
        """The first file that can be opened, which the others are held against."""
        failure: Exception | None = None
        for file in self.files:
            try:
                return self.opener(file), file
            except Exception as e:
                if not self.tolerant:
                    raise
                failure = failure or e
        raise ValueError(f"none of {len(self.files)} files can be read: {failure}")

    def _of_file(self, file: str) -> dict[str, str]:
        found = self.pattern.search(file) if self.pattern else None
        return {k: v or "" for k, v in found.groupdict().items()} if found else {}

    def _groups(self, file: str) -> dict[str, bool]:
        """The groups of the path, and whether they are numbers."""
        return {k: bool(re.fullmatch(r"[0-9]+", v)) for k, v in self._of_file(file).items()}

    def _told(self, source: Any, name: str) -> dict[str, str]:
        v = source.variables.get(name)
        held = {k: str(x) for k, x in v.attributes.items() if k not in ("_FillValue", "missing_value", "scale_factor", "add_offset")} if v is not None else {}
        if self.kinds.get(name) == "timestamp_ntz":
            held.pop("units", None)
        return held

    def _axis_type(self, source: Any, dim: str) -> str:
        axis = source.variables.get(dim)
        if axis is None or axis.dims != (dim,):
            return "int"
        return "timestamp_ntz" if self.decode and _since(str(axis.attributes.get("units", ""))) else axis.sql_type

    def _inner(self, source: Any) -> list[Any]:
        """What all files must have: kinds of the variables, units of the axes, and all axes but the leading one."""
        variables = [source.variables[n] for n in self.names]
        units = [str(source.variables[d].attributes.get("units", "")) for d in self.dims if d in source.variables]
        return [[(v.dims, v.sql_type) for v in variables], units, [self._axis(source, d).to_pylist() for d in self.dims[1:]]]

    def _axis(self, source: Any, dim: str) -> pa.Array:
        held = source.__dict__.setdefault("axes", {})
        if dim not in held:
            held[dim] = self._read_axis(source, dim)
        return held[dim]

    def _read_axis(self, source: Any, dim: str) -> pa.Array:
        axis = source.variables.get(dim)
        if axis is None or axis.dims != (dim,):
            size = next(n for v in source.variables.values() for d, n in zip(v.dims, v.shape) if d == dim)
            return pa.array(np.arange(size, dtype=np.int32))
        values = axis.unpacked(source.slab(dim))
        since = _since(str(axis.attributes.get("units", ""))) if self.decode else None
        if since is None:
            return values
        micros = np.rint(values.to_numpy(zero_copy_only=False) * float(since[0])).astype("timedelta64[us]")
        return pa.array(since[1] + micros, pa.timestamp("us"))

    def _boxes(self, source: Any) -> list[list[tuple[int, int]]]:
        """Ranges of the indices outside of which no row is asked for: each run of the leading
        index with the hull of what is asked for of each other one."""
        out: list[list[tuple[int, int]]] = []  # of each dimension
        for i, dim in enumerate(self.dims):
            axis = self._axis(source, dim)
            values = axis.to_numpy(zero_copy_only=False) if pa.types.is_timestamp(axis.type) else axis.cast(pa.float64()).to_numpy(zero_copy_only=False)
            chosen = dim in self.ranges and dim not in self._groups(self.first_file)
            keep = _passing(values, self.ranges[dim]) if chosen else np.ones(len(values), bool)
            if i == 0:
                keep[: self.range[0]] = False
                keep[len(keep) if self.range[1] is None else max(0, self.range[1]) :] = False
            found = np.flatnonzero(keep)
            if not len(found):
                return []
            runs = np.split(found, np.flatnonzero(np.diff(found) > 1) + 1) if i == 0 else [found]
            out.append([(int(run[0]), int(run[-1]) + 1) for run in runs])
        return [list(box) for box in itertools.product(*out)]

    def _wanted(self, file: str) -> bool:
        of_file = {k: int(v) for k, v in self._of_file(file).items() if v.isdigit()}
        return all(_passing(np.array([of_file[k]]), r)[0] for k, r in self.ranges.items() if k in of_file)

    def _parts(self, source: Any) -> list[dict]:
        if not self.dims:
            return [{"begin": [], "end": []}]
        return [part for box in self._boxes(source) for part in source.parts([*self.names, *self.dims], box)]

    def partitions(self) -> list[InputPartition]:
        files = [f for f in self.files if self._wanted(f)]
        if len(files) != 1 or self.tolerant:
            return [_Part(f, None) for f in files]
        return [_Part(files[0], p) for p in self._parts(self.opener(files[0]))]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        try:
            source = self.opener(partition.file)
            if absent := [n for n in self.names if n not in source.variables]:
                raise KeyError(f"no variables {absent} in {partition.file}")
            if partition.file != self.first_file and self._inner(source) != self.inner:
                raise ValueError(f"kinds, units or axes are not those of {self.first_file}")
            for part in self._parts(source) if partition.box is None else [partition.box]:
                yield self._batch(source, part, partition.file)
        except Exception as failure:
            if not self.tolerant:
                raise
            reason = (str(failure) or type(failure).__name__).splitlines()[0]
            yield self._rows({"error": pa.array([reason])}, partition.file, 1)

    def _batch(self, source: Any, box: dict, file: str) -> pa.RecordBatch:
        made: dict[str, pa.Array] = {}
        shape = [b - a for a, b in zip(box["begin"], box["end"])]
        for i, (dim, a, b) in enumerate(zip(self.dims, box["begin"], box["end"])):
            place = pa.array(np.tile(np.repeat(np.arange(a, b), math.prod(shape[i + 1 :])), math.prod(shape[:i])))
            made[dim], made[f"{dim}_idx"] = self._axis(source, dim).take(place), place
        for name in self.names:
            made[name] = source.variables[name].unpacked(source.block(name, box) if shape else source.slab(name))
        return self._rows(made, file, math.prod(shape))

    def _rows(self, made: dict[str, pa.Array], file: str, n: int) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        of_file, out = self._of_file(file) | {"file": file}, to_arrow_schema(self.schema)
        columns = []
        for f in out:
            if f.name in made and f.name not in of_file:
                columns.append(made[f.name].cast(f.type))
            else:
                text = of_file.get(f.name)
                value = (int(text) if (text or "").isdigit() else None) if pa.types.is_integer(f.type) else text if pa.types.is_string(f.type) else None
                columns.append(pa.array([value] * n, f.type))
        return pa.RecordBatch.from_arrays(columns, schema=out)


class _ArraySource(DataSource):
    opener: type

    def schema(self) -> StructType:
        return _ArrayReader(self.opener, dict(self.options)).schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrayReader(self.opener, dict(self.options))


class NetCDFSource(_ArraySource):
    opener = NetCDF

    @classmethod
    def name(cls) -> str:
        return "netcdf"


class ZarrSource(_ArraySource):
    opener = Zarr

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def writer(self, schema: StructType, overwrite: bool) -> ZarrWriter:
        return ZarrWriter(dict(self.options), schema)


def header(path: str, format: str) -> Any:
    """Names, shapes, attributes and axes of the first file of a path; no values are read."""
    return {"netcdf": NetCDF, "zarr": Zarr}[format](expand(path)[0])


def load(spark: SparkSession, format: str, path: str | list[str], ranges: Ranges | None = None, **options: str) -> DataFrame:
    """The table of a path. `ranges` has lists of (from, to) for dimensions and groups of the
    path, ends included and None for open; only what they touch is read, and rows outside of
    them are left out."""
    from functools import reduce
    from operator import or_

    from pyspark.sql import functions as F

    register(spark)
    told = {k: [[x if x is None or isinstance(x, (int, float)) else str(x).replace(" ", "T") for x in one] for one in v] for k, v in (ranges or {}).items()}
    df = spark.read.format(format).options(**options).option("ranges", json.dumps(told)).load(path)
    for name, lists in told.items():
        kind = df.schema[name].dataType
        end = lambda x: F.lit(x).cast(kind) if isinstance(x, str) else F.lit(x)  # noqa: B023, E731
        one = [F.lit(True) if a is None else F.col(f"`{name}`") >= end(a) for a, _ in lists], [F.lit(True) if b is None else F.col(f"`{name}`") <= end(b) for _, b in lists]
        # the source has chosen already; this is for axes that are in no order
        unread = F.col("error").isNotNull() if options.get("on_error") == "row" else F.lit(False)
        df = df.where(reduce(or_, (a & b for a, b in zip(*one)), unread)) if 0 < len(lists) <= 16 else df
    return df


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session. Workers get this module with the reader, so it
    need not be installed where they run."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (NetCDFSource, ZarrSource):
        spark.dataSource.register(source)
