"""What the corpus operators share: scratch tables, bounded broadcasts, batching."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its files take no more bytes than this.
BROADCAST_BYTES = 4 << 20
#: Python kernels work on slices of a batch with about this many characters.
SLICE_CHARS = 2 << 20

_roots: dict[str, str] = {}
_owners: list[list[Scratch]] = []


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors
    share. Only where that setting is absent and the master is local (tests) a temporary
    folder of this machine takes its place; a cluster without the setting is an error.
    """
    key = spark.sparkContext.applicationId
    if key not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
            if held.isDefined():
                shared = held.get()
            elif spark.sparkContext.master.startswith("local"):
                shared = f"file://{tempfile.mkdtemp(prefix='skillgrid-')}"
            else:
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _roots[key] = root = f"{shared.rstrip('/')}/skillgrid-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, root)
    return _roots[key]


def _forget(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        fs, at = _filesystem(spark, root)
        fs.delete(at, True)


class Scratch:
    """Tables written under the shared folder: they cut lineage, outlive executors,
    have an exact size, and are read again with column pruning.

    An operator's result is read from its tables lazily, so they belong to whoever uses
    the result: within owned() they can be dropped as soon as it is written, else they
    stay until the application ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        if _owners:
            _owners[-1].append(self)
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made: list[str] = []

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.made)}"
        self.made.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bytes(self, df: DataFrame) -> int:
        """Bytes of a table that table() returned."""
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def hint(self, df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
        """A broadcast hint if the table's files are small; else the table as it is,
        so that the join shuffles and AQE splits its skewed keys."""
        return F.broadcast(df) if self.bytes(df) <= limit else df

    def drop(self) -> None:
        fs, at = _filesystem(self.spark, self.base)
        fs.delete(at, True)


@contextlib.contextmanager
def owned() -> Iterator[None]:
    """Drops the scratch tables opened within the block at its end. What was built on
    them must have been written by then."""
    _owners.append([])
    try:
        yield
    finally:
        for scratch in _owners.pop():
            scratch.drop()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed: they search the
    folder that holds it, if their machine has that folder, besides what they are sent."""
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(sizes: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about `limit` at most
    (a single larger item makes a range of its own)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, Iterable]], size_of: str | None = None, done: Callable[[], None] | None = None
) -> DataFrame:
    """Arrow batches through `work`, from columns as lists to columns as lists. With
    `size_of`, a string or binary column, each call gets about SLICE_CHARS characters of it. After a
    partition `done` is called, and the worker, which stays for later tasks, hands its
    freed memory back."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            if size_of is None:
                ranges = [(0, batch.num_rows)] if batch.num_rows else []
            else:
                column = batch.column(names.index(size_of))
                length = pc.binary_length if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pc.utf8_length
                ranges = slices(pc.fill_null(length(column), 0).to_pylist())
            for a, b in ranges:
                part = batch.slice(a, b - a)
                made = work({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
                made = part = None
        if done is not None:
            done()
        hand_back()

    reach(df.sparkSession)
    return df.mapInArrow(run, schema)


def search_sorted(bounds: list[int], value: Column) -> Column:
    """How many of the ascending `bounds` are at most `value`; binary search in the JVM."""
    if not bounds:
        return F.lit(0)
    table, n = F.lit(bounds), len(bounds)
    steps = F.lit([1 << k for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) <= value), at + step).otherwise(at),
    )
