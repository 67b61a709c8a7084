"""Document fingerprints from content-defined chunks.

A gear hash over the UTF-8 bytes rolls along each text. A chunk ends where the hash
has a run of zero bits: a long run before the normal size and a short one after it
(normalised chunking), so sizes gather around the normal size, and an insertion moves
only the chunks that it touches. A fingerprint is the set of chunk digests with their
lengths, as base64 of sorted 9-byte records (8 of digest, 1 of length). The likeness
of two fingerprints is containment: the length of shared chunks over the length of
the smaller set.

Null texts count as empty; an empty text has the fingerprint "", which is like itself
(1.0) and unlike all others (0.0). Repeated ids and texts are kept row by row; equal texts
have equal fingerprints. Very long texts are chunked whole: a fingerprint has 12 characters
for each distinct chunk, about one for every three of the text, as containment needs the
whole set. An empty table gives no rows; only id and text are read, whatever other columns
are called.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, map_batches, reach, shuffle_partitions, slices

MIN, NORMAL, MAX = 8, 32, 128
#: Zero bits asked for at the top of the hash before and after the normal size.
STRICT, LOOSE = 7, 3
_WINDOW = 32
#: Bytes of text for a task beyond the usual number of tasks, keys that the driver sees for
#: each range of rows, and characters of a text that tell rows of one id apart there.
TASK_BYTES, SAMPLES, PREFIX = 1 << 30, 8, 32


def _gear() -> np.ndarray:
    """256 well-mixed words from a multiplicative rule; byte 255, which no UTF-8 text
    has, gets 0 so that it can keep neighbours in one buffer apart."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    out = x.astype(np.uint32)
    out[255] = 0
    return out


GEAR = _gear()


def chunk_spans(blobs: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all blobs, and per chunk, in order: blob, begin, end in the buffer."""
    gap = b"\xff" * _WINDOW
    flat = b"".join(x for b in blobs for x in (gap, b))
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    begin = np.cumsum(size + _WINDOW) - size
    end = begin + size
    hashes = GEAR[np.frombuffer(flat, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        more = hashes[:-s] << np.uint32(s)
        hashes[s:] += more
    loose = np.flatnonzero(hashes < np.uint32(1 << (32 - LOOSE)))
    strict = loose[hashes[loose] < np.uint32(1 << (32 - STRICT))]
    far = np.array([len(flat) + MAX])
    loose, strict = np.append(loose, far), np.append(strict, far)
    live = np.flatnonzero(size)
    at = begin[live]
    owners, begins, ends = [], [], []
    while live.size:
        first = strict[np.searchsorted(strict, at + (MIN - 1))]
        later = loose[np.searchsorted(loose, at + (NORMAL - 1))]
        cut = np.where(first < at + (NORMAL - 1), first, later) + 1
        cut = np.minimum(np.minimum(cut, at + MAX), end[live])
        owners.append(live)
        begins.append(at)
        ends.append(cut)
        more = cut < end[live]
        live, at = live[more], cut[more]
    if not owners:
        none = np.empty(0, np.int64)
        return flat, none, none, none
    owner, a, b = np.concatenate(owners), np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(a)
    return flat, owner[order], a[order], b[order]


class Prints:
    """Digest sets of a list of texts: parallel arrays sorted by text and digest."""

    def __init__(self, blobs: list[bytes]) -> None:
        flat, owner, a, b = chunk_spans(blobs)
        digest = xxhash.xxh3_64_intdigest
        found = np.fromiter((digest(flat[i:j]) for i, j in zip(a.tolist(), b.tolist())), np.uint64, len(a))
        order = np.lexsort((found, owner))
        owner, found, width = owner[order], found[order], (b - a)[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
        self.owner, self.digest, self.width = owner[fresh], found[fresh], width[fresh]
        self.count = len(blobs)
        self.edges = np.searchsorted(self.owner, np.arange(self.count + 1))
        self.total = np.bincount(self.owner, self.width, self.count)

    def strings(self) -> list[str]:
        records = np.empty((len(self.owner), 9), np.uint8)
        records[:, :8] = self.digest.astype(">u8").view(np.uint8).reshape(-1, 8)
        records[:, 8] = self.width
        raw, e = records.tobytes(), (self.edges * 9).tolist()
        return [base64.b64encode(raw[e[i] : e[i + 1]]).decode() for i in range(self.count)]


def likeness(a: Prints, b: Prints, shift: int = 0) -> np.ndarray:
    """Containment of text i of `a` and text i + shift of `b`, for all i that have both."""
    n = min(a.count, b.count - shift)
    owner = np.concatenate((a.owner, b.owner - shift))
    digest, width = np.concatenate((a.digest, b.digest)), np.concatenate((a.width, b.width))
    keep = (owner >= 0) & (owner < n)
    owner, digest, width = owner[keep], digest[keep], width[keep]
    order = np.lexsort((digest, owner))
    owner, digest, width = owner[order], digest[order], width[order]
    same = np.flatnonzero((owner[1:] == owner[:-1]) & (digest[1:] == digest[:-1]))
    shared = np.bincount(owner[same], width[same], n)
    p, q = a.total[:n], b.total[shift : shift + n]
    least = np.minimum(p, q)
    return np.where(least > 0, shared / np.maximum(least, 1), (p == q).astype(float))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, fingerprint, n_chunks and weight (bytes in distinct chunks) of each row."""
    kind = dict(df.dtypes)[id_col]

    def work(rows: dict[str, list]) -> dict[str, list]:
        p = Prints([(x or "").encode() for x in rows["t"]])
        return {id_col: rows["k"], "fingerprint": p.strings(), "n_chunks": np.diff(p.edges), "weight": p.total.astype(np.int64)}

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return map_batches(rows, f"`{id_col}` {kind}, fingerprint string, n_chunks long, weight long", work, "t")


def _bounds(rows: DataFrame) -> tuple[list[tuple[int, str]], int]:
    """Least keys of ranges of rows in order of (o, p), and the tasks that they are for.

    Each bound is the key of a row, so no range is empty. Tasks grow with the bytes of
    text; the driver takes SAMPLES keys for each of four ranges a task, of PREFIX characters."""
    n, size, least = rows.agg(F.count("*"), F.sum(F.octet_length("t")), F.min(F.struct("o", "p"))).first()
    if not n:
        return [], 1
    tasks = max(shuffle_partitions(rows.sparkSession), -(-size // TASK_BYTES))
    keys = rows.select("o", "p").sample(min(1.0, 4 * tasks * SAMPLES / n), 1).collect()
    return sorted({tuple(least), *sorted(map(tuple, keys))[::SAMPLES]}), tasks


def _range_of(bounds: list[tuple[int, str]]) -> Column:
    """The number of the range in which (o, p) lies."""
    if len(bounds) < 2:
        return F.lit(0)
    ids, prefixes, n = F.lit([o for o, _ in bounds]), F.lit([p for _, p in bounds]), len(bounds)
    reached = lambda i: (F.get(ids, i) < F.col("o")) | ((F.get(ids, i) == F.col("o")) & (F.get(prefixes, i) <= F.col("p")))
    steps = F.lit([1 << k for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < n) & reached(at + step), at + step).otherwise(at))


def successive_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, in which the last half of the code
    points gives way to as many first ones of the next text in descending order of id
    (after the last: the first; among equal ids by text; null ids come last).

    Rows are dealt by ranges of id and beginning of the text, so that rows of one id spread
    too (but for equal beginnings), and each range also gets the first row of the next
    one: a text crosses the network once and memory holds one batch.
    """
    key = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    rows = df.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), key.alias("o"))
    rows = rows.withColumn("p", F.substring("t", 1, PREFIX))
    bounds, tasks = _bounds(rows)
    rows = rows.withColumn("r", _range_of(bounds))
    if bounds:
        least = (F.get(F.lit([o for o, _ in bounds]), F.col("r")) == F.col("o")) & (F.get(F.lit([p for _, p in bounds]), F.col("r")) == F.col("p"))
        firsts = rows.where(least).groupBy("r", "o").agg(F.min("t").alias("t"))
        before = F.pmod(F.col("r") - 1, F.lit(len(bounds)))
        firsts = firsts.select(before.alias("r"), F.lit(1).alias("guest"), "o", F.lit(None).cast("long").alias("k"), "t")
        rows = rows.select("r", F.lit(0).alias("guest"), "o", "k", "t").union(firsts)
    else:
        rows = rows.select("r", F.lit(0).alias("guest"), "o", "k", "t")
    rows = rows.repartition(tasks, "r").sortWithinPartitions("r", "guest", "o", "t")
    schema = pa.schema(
        [
            (id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ]
    )

    def emit(keys: list, texts: list[str], n: int) -> pa.RecordBatch:
        """Rows for the first n texts; the text after each is its next one."""
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts[:n], texts[1 : n + 1])]
        blobs = [x.encode() for x in edited]
        p, q = Prints([x.encode() for x in texts]), Prints(blobs)
        columns = [keys[:n], list(map(len, texts[:n])), [hashlib.sha256(x).hexdigest() for x in blobs]]
        columns += [p.strings()[:n], q.strings(), likeness(p, q)[:n], likeness(p, p, 1)[:n]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[str] = []
        for batch in batches:
            got = [batch.column(i).to_pylist() for i in (1, 3, 4)]
            for a, b in slices([len(x) for x in got[2]]):
                for is_guest, k, t in zip(*(c[a:b] for c in got)):
                    if not is_guest:
                        keys.append(k)
                        texts.append(t)
                    else:  # the last of its range
                        yield emit(keys, [*texts, t], len(keys))
                        keys, texts = [], []
                if len(texts) > 1:
                    yield emit(keys, texts, len(texts) - 1)
                    keys, texts = keys[-1:], texts[-1:]

    reach(df.sparkSession)
    kinds = ("long", "long", "string", "string", "string", "double", "double")
    return rows.mapInArrow(walk, ", ".join(f"`{f.name}` {t}" for f, t in zip(schema, kinds)))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return successive_edits(load(spark, sf_dir, "documents"))
