"""Removal of byte strings that an earlier document has too (exact, of LENGTH bytes).

Every window of LENGTH bytes is governed by its minimizer, the gram of GRAM bytes with
the least hash in it (leftmost among equals), which depends on the window's bytes alone:
equal windows have equal minimizers, wherever they are. So only windows whose minimizer
is in two documents or more can repeat, and windows with different minimizers need not
meet. The steps:

1. Copies: a text that is also whole in a document with a smaller id goes as a whole.
2. Blocks of documents send their grams (48 bits of hash; a collision only adds work) to
   buckets by hash. A bucket finds grams of two documents and answers each block with the
   least document of each. Grams that many rows of one block have are sent once.
3. The windows of shared grams are cut out as pieces: runs of windows whose grams have
   the same least document, cut anew at grams chosen by hash so that equal passages give
   equal pieces. Equal pieces are counted once, with the least of their documents.
   Windows of very frequent grams become pieces one by one, which spread by content. Pieces
   meet by owner, the least document of their grams; those of an owner with more than
   OWNER_BYTES of them are cut again by gram and meet by gram.
4. In groups of pieces a Burrows-Wheeler transform is extended backward, breadth first,
   from the empty string: an interval of suffixes with the prefix w splits by preceding
   byte into intervals of longer strings, and where such an interval ends for the first
   time, the common prefix there has the length of w. This yields common prefixes by
   increasing length and stops at LENGTH: suffixes not separated by then share a window.
   Each window's owner is the least document in its interval.
5. A document loses the windows whose owner is smaller than itself.

No task gathers more than bounded amounts: a bucket has the grams of about BUCKET_BYTES of
text, as buckets grow with the input, a group about GROUP_BYTES of pieces besides one owner
of at most OWNER_BYTES or one gram with under FREQUENT rows.

Null texts are empty; texts under LENGTH bytes lose nothing. Rows with a null id neither
lose nor cause anything, nor do rows with equal ids among each other. Very long texts are
treated whole. An empty table gives no rows; only id and text are read, whatever other
columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, load, map_batches, reach, shuffle_partitions, slices

LENGTH, GRAM = 50, 28
SPAN = LENGTH - GRAM + 1
#: Grams with this many rows in a block are sent once for the block; grams in so many
#: documents overall have their windows dealt by their own content.
BLOCK_ROWS, FREQUENT = 32, 200_000
#: Bytes of text of a bucket of grams, and of pieces in a group, about; and most bytes of
#: pieces of one owner that stay together.
BUCKET_BYTES, GROUP_BYTES, OWNER_BYTES = 64 << 20, 6 << 20, 6 << 20
_GAP = b"\xff" * 64
_KEY = np.uint64((1 << 48) - 1)
_BYTES = np.random.default_rng(0xB175).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_OPEN = np.iinfo(np.int64).max


def _ahead(x: np.ndarray, n: int, fill) -> np.ndarray:
    out = np.empty_like(x)
    out[: len(x) - n] = x[n:]
    out[len(x) - n :] = fill
    return out


def _hashes(flat: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the `size` bytes from each place on, by doubling."""
    power, width, out, done = _BYTES[flat], 1, None, 0
    while True:
        if size & width:
            part = _ahead(power, done, 0)
            out = part if out is None else out * np.uint64(pow(_STEP, width, 1 << 64)) + part
            done += width
        if done == size:
            return out
        power = power * np.uint64(pow(_STEP, width, 1 << 64)) + _ahead(power, width, 0)
        width *= 2


def grams(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: blob, first window, windows, key of the gram."""
    flat = np.frombuffer(b"".join(x for b in blobs for x in (b, _GAP)), np.uint8)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    begin = np.cumsum(size + len(_GAP)) - size - len(_GAP)
    have = size >= LENGTH
    if not have.any():
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    h = _hashes(flat, GRAM)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    done, width = low, 1
    while width < SPAN:  # least of SPAN grams from each place on
        step = min(width, SPAN - width)
        done = np.minimum(done, _ahead(done, step, np.uint64(2**64 - 1)))
        width += step
    place = (done & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(len(flat), np.int8)
    ends = np.append(begin[have], begin[have] + size[have] - LENGTH + 1)
    np.add.at(change, begin[have], 1)
    np.add.at(change, ends[int(have.sum()) :], -1)
    valid = np.flatnonzero(np.cumsum(change, dtype=np.int8) > 0)
    at = place[valid]
    fresh = np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)))
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(valid)))
    blob = np.searchsorted(begin, valid[first], "right") - 1
    return blob, valid[first] - begin[blob], count, h[at[first]] & _KEY


# --- blocks and buckets of grams -------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays by byte planes, compressed; the planes of small numbers vanish."""
    parts = []
    for a in arrays:
        parts.append(len(a).to_bytes(8, "little"))
        parts.append(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n).T).view("<i8").reshape(-1))
        at += 8 + 8 * n
    return out


_BUCKET_ROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _send_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows for buckets. Kind 0: grams and rows of a block, with the rows' ids; kind 1:
    grams that many of its rows have, once each; kind 2: these rows, to be passed on."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            texts = batch.column(1).to_pylist()
            keys, rows = [], []
            for a, b in slices([len(t or "") for t in texts]):
                blob, _, _, key = grams([(t or "").encode() for t in texts[a:b]])
                keys.append(key.astype(np.int64))
                rows.append(blob + a)
            key, row = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, rows))
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            key, row = key[fresh], row[fresh]
            if not len(key):
                continue
            block = xxhash.xxh3_64_intdigest(ids.tobytes()) - (1 << 63)
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(head, len(key)))
            least = np.minimum.reduceat(ids[row], head)
            most = np.maximum.reduceat(ids[row], head)
            many = count >= BLOCK_ROWS
            few = ~np.repeat(many, count)
            out: list[tuple] = []
            edges = (np.arange(buckets + 1) * ((1 << 48) / buckets)).astype(np.int64)
            k, r = key[few], row[few]
            cuts = np.searchsorted(k, edges)
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:  # with the ids of the rows that are in it, not of the whole block
                    used, mine = np.unique(r[a:b], return_inverse=True)
                    out.append((i, block, 0, _pack(np.diff(k[a:b], prepend=0), mine, ids[used])))
            if many.any():
                k = key[head][many]
                cuts = np.searchsorted(k, edges)
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        out.append((i, block, 1, _pack(np.diff(k[a:b], prepend=0), least[many][a:b], most[many][a:b], count[many][a:b])))
                out.append((block % buckets, block, 2, _pack(key[~few], row[~few], ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BUCKET_ROW)], schema=_BUCKET_ROW)

    return docs.select("k", "t").mapInArrow(send, "bucket int, block long, kind int, data binary")


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of a bucket to its blocks. Kind 0: keys, rows, least documents (negative
    and shifted for frequent grams), ids; kind 1: keys and least documents; 2 as it came."""
    table = pa.Table.from_batches(list(batches))
    block, kind = np.array(table["block"]), np.array(table["kind"])
    data = [_unpack(x) if k < 2 else x for x, k in zip(table["data"].to_pylist(), kind.tolist())]
    key, low, high, count = [], [], [], []
    for x, k in zip(data, kind.tolist()):
        if k == 2:
            continue
        x[0] = np.cumsum(x[0])
        key.append(x[0])
        low.append(x[2][x[1]] if k == 0 else x[1])
        high.append(x[2][x[1]] if k == 0 else x[2])
        count.append(np.ones(len(x[0]), np.int64) if k == 0 else x[3])
    out = [(b, 2, x) for b, k, x in zip(block.tolist(), kind.tolist(), data) if k == 2]
    if key:
        keys, group = np.unique(np.concatenate(key), return_inverse=True)
        least, most = np.full(len(keys), _OPEN), np.full(len(keys), -_OPEN - 1)
        np.minimum.at(least, group, np.concatenate(low))
        np.maximum.at(most, group, np.concatenate(high))
        frequent = np.bincount(group, np.concatenate(count), len(keys)) >= FREQUENT
        shared, at = most > least, 0
        for x, b, k in zip((d for d, k in zip(data, kind) if k < 2), block[kind < 2].tolist(), kind[kind < 2].tolist()):
            g = group[at : at + len(x[0])]
            at += len(x[0])
            hit = shared[g]
            if hit.any():
                g = g[hit]
                if k == 0:
                    used, rows = np.unique(x[1][hit], return_inverse=True)
                    out.append((b, 0, _pack(x[0][hit], rows, least[g], frequent[g], x[2][used])))
                else:
                    out.append((b, 1, _pack(x[0][hit], least[g], frequent[g])))
    names, kinds = ("block", "kind", "data"), (pa.int64(), pa.int32(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=list(names))


def _of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a block: its shared grams and their least documents."""
    table = pa.Table.from_batches(list(batches))
    found, hot, late = [], [], []
    for k, x in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
        (found, hot, late)[k].append(_unpack(x))
    ids, keys, least, often = [[x[4][x[1]] for x in found], [x[0] for x in found], [x[2] for x in found], [x[3] for x in found]]
    if hot and late:
        k, m, f = (np.concatenate([x[i] for x in hot]) for i in range(3))
        order = np.argsort(k)
        k, m, f = k[order], m[order], f[order]
        for x in late:
            at = np.minimum(np.searchsorted(k, x[0]), len(k) - 1)
            hit = k[at] == x[0]
            ids.append(x[2][x[1][hit]])
            keys.append(x[0][hit])
            least.append(m[at[hit]])
            often.append(f[at[hit]])
    schema = pa.schema([("k", pa.int64()), ("keys", pa.binary())])
    if ids:
        i, k, m, f = map(np.concatenate, (ids, keys, least, often))
        order = np.lexsort((k, i))
        i, k, m, f = i[order], k[order], m[order], f[order]
        head = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        ends = np.append(head[1:], len(i))
        rows = [np.stack((k[a:b], m[a:b], f[a:b])).astype("<i8").tobytes() for a, b in zip(head.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(i[head], pa.int64()), pa.array(rows, pa.binary())], schema=schema)
    else:
        yield pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


# --- pieces ----------------------------------------------------------------------------


def _name(piece: bytes) -> tuple[int, int]:
    name = xxhash.xxh3_128_intdigest(piece)
    return (name >> 64) - (1 << 63), (name & (2**64 - 1)) - (1 << 63)


def _cut_pieces(rows: dict[str, list]) -> dict[str, list]:
    blobs = [t.encode() for t in rows["t"]]
    blob, start, count, key = grams(blobs)
    known = [np.concatenate([np.frombuffer(y, "<i8").reshape(3, -1) for y in x], 1) for x in rows["keys"]]
    size = np.fromiter((x.shape[1] for x in known), np.int64, len(known))
    where = np.repeat(np.arange(len(known)), size)
    k, least, often = np.concatenate(known, 1) if known else np.empty((3, 0), np.int64)
    # (blob, key) of known grams, sorted; blobs of a slice are few, so both fit 64 bits
    mine = (where.astype(np.uint64) << np.uint64(48)) | k.astype(np.uint64)
    order = np.argsort(mine)
    mine, least, often = mine[order], least[order], often[order]
    want = (blob.astype(np.uint64) << np.uint64(48)) | key
    at = np.minimum(np.searchsorted(mine, want), max(0, len(mine) - 1))
    hit = np.flatnonzero(mine[at] == want) if len(mine) else np.empty(0, np.int64)
    out: dict[str, list] = {c: [] for c in ("bucket", "piece", "p", "q", "k", "h", "at")}

    def add(i: int, a: int, b: int, bucket: int) -> None:
        piece = blobs[i][a:b]
        for c, v in zip(out, (bucket, piece, *_name(piece), rows["k"][i], rows["h"][i], a)):
            out[c].append(v)

    blob, start, count, cut = blob[hit], start[hit], count[hit], (key[hit] & np.uint64(15)) == 0
    owner, often = least[at[hit]], often[at[hit]] > 0
    for j in np.flatnonzero(often).tolist():
        for a in range(int(start[j]), int(start[j] + count[j])):
            add(int(blob[j]), a, a + LENGTH, xxhash.xxh3_64_intdigest(blobs[blob[j]][a : a + LENGTH]) - (1 << 63))
    rest = np.flatnonzero(~often)
    blob, start, count, cut, owner = blob[rest], start[rest], count[rest], cut[rest], owner[rest]
    new = np.ones(len(rest), bool)
    new[1:] = (blob[1:] != blob[:-1]) | (start[1:] != start[:-1] + count[:-1]) | (owner[1:] != owner[:-1]) | cut[1:]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(rest))[: len(head)] - 1
    buckets = [xxhash.xxh3_64_intdigest(o.tobytes()) - (1 << 63) for o in owner[head].astype("<i8")]
    for i, a, b, bucket in zip(blob[head].tolist(), start[head].tolist(), (start + count)[tail].tolist() if len(head) else [], buckets):
        add(i, a, b + LENGTH - 1, bucket)
    return out


def _cut_by_gram(rows: dict[str, list]) -> dict[str, list]:
    """The pieces cut again into the runs of windows of one gram, as bucket (of the gram),
    piece, the new piece's name, the place in the old one, and what is known of that."""
    out: dict[str, list] = {c: [] for c in ("bucket", "piece", "p", "q", "of_p", "of_q", "at", "low", "high")}
    blob, start, count, key = grams(rows["piece"])
    for i, a, n, k in zip(blob.tolist(), start.tolist(), count.tolist(), key.astype("<u8")):
        piece = rows["piece"][i][a : a + n + LENGTH - 1]
        bucket = xxhash.xxh3_64_intdigest(k.tobytes()) - (1 << 63)
        old = (rows["p"][i], rows["q"][i], a, rows["low"][i], rows["high"][i])
        for c, v in zip(out, (bucket, piece, *_name(piece), *old)):
            out[c].append(v)
    return out


# --- the transform ---------------------------------------------------------------------


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Places of the rotations of a text in order of their first 64 bytes."""
    key = text.astype(np.uint64)
    for n in (1, 2, 4):
        key = (key << np.uint64(8 * n)) | np.roll(key, -n)
    for n in (8, 16, 32, 64):
        order = np.argsort(key)
        if n == 64:
            return order
        s = key[order]
        rank = np.empty(len(text), np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])), dtype=np.uint64)
        if rank[order[-1]] == len(text) - 1:
            return order
        key = (rank << np.uint64(32)) | np.roll(rank, -n)
    return order


def separated(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in suffix order (and the end) whether the common prefix with the
    place before is under `length`, by breadth-first backward extension on the
    transform; the common prefixes come up by increasing length."""
    n = len(text)
    last = text[order - 1]  # the transform: the byte before each suffix
    back = np.empty(n, np.int32)  # where the suffix one byte longer stands
    back[np.argsort(last, kind="stable")] = np.arange(n, dtype=np.int32)
    # the first byte of each suffix, and room for the interval from which it was reached
    first, owner = np.sort(text), np.empty(n, np.int32)
    apart = np.zeros(n + 1, bool)
    apart[0] = apart[n] = True
    lows, highs = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length):
        size = highs - lows
        which = np.repeat(np.arange(len(lows), dtype=np.int32), size)
        shift = lows - (np.cumsum(size, dtype=np.int32) - size)
        to = back[np.arange(len(which), dtype=np.int32) + shift[which]]
        owner[to] = which
        to.sort()
        mine, byte = owner[to], first[to]
        fresh = np.ones(len(to), bool)
        fresh[1:] = (to[1:] != to[:-1] + 1) | (mine[1:] != mine[:-1]) | (byte[1:] != byte[:-1])
        heads = np.flatnonzero(fresh)
        lows, highs = to[heads], to[np.append(heads[1:], len(to)) - 1] + 1
        new = ~apart[highs]
        lows, highs = lows[new], highs[new]
        if not len(lows):
            break
        apart[highs] = True
    return apart


def owners(pieces: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece the least document (of those given for the pieces) that has each of
    its windows."""
    text = np.frombuffer(b"".join(x for p in pieces for x in (p, b"\xff")) + b"\xff" * 64, np.uint8)
    order = sort_suffixes(text)
    apart = separated(text, order, length)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(size + 1) - size - 1
    of = np.full(len(text), _OPEN)
    windows = size - length + 1
    which = np.repeat(np.arange(len(pieces)), windows)
    at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
    of[at] = docs[which]
    heads = np.flatnonzero(apart[:-1])
    least = np.minimum.reduceat(of[order], heads)
    back = np.empty(len(text), np.int64)
    back[order] = np.repeat(least, np.diff(np.append(heads, len(text))))
    return np.split(back[at], np.cumsum(windows)[:-1])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches))
    p, q, low, high = (np.array(table[c]) for c in ("p", "q", "low", "high"))
    out: list[tuple] = []
    for i, own in enumerate(owners(table["piece"].to_pylist(), low)):
        if own.min() < high[i]:
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            out.append((p[i], q[i], head, np.append(head[1:], len(own)), own[head]))
    names = ["p", "q", "begins", "ends", "owners"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)


# --- the operator ----------------------------------------------------------------------


def _owned(pieces: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """p, q, begins, ends, owners: runs of windows of a piece with one owner."""
    groups = max(1, -(-total // GROUP_BYTES))
    shape = "p long, q long, begins array<int>, ends array<int>, owners array<long>"
    return scratch.table(pieces.withColumn("g", F.pmod("bucket", F.lit(groups))).groupBy("g").applyInArrow(_own, shape))


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """k, h, begin, end: bytes to remove, as overlapping spans, from rows k, t, h."""
    spark = docs.sparkSession
    reach(spark)
    long = docs.where(f"k is not null and octet_length(t) >= {LENGTH}")
    seen = scratch.table(long.select("k", "h", F.xxhash64(F.lit(1), "t").alias("h2"), F.octet_length("t").alias("n")))
    firsts = scratch.table(seen.groupBy("h", "h2", "n").agg(F.min("k").alias("first"), F.max("k").alias("most")).where("first < most").drop("most"))
    # as a join of two tables: broadcast, or split where a text has very many copies
    copies = scratch.table(seen.join(scratch.hint(firsts), ["h", "h2", "n"]).where("k > first").select("k", "h", "n").distinct())
    whole = copies.select("k", "h", F.lit(0).alias("begin"), F.col("n").cast("int").alias("end"))
    texts = long.join(scratch.hint(copies.select("k", "h")), ["k", "h"], "left_anti")
    size = int(seen.agg(F.sum("n")).first()[0] or 0)
    buckets = max(2 * shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    asked = _send_grams(texts, buckets)
    if buckets > 2 * shuffle_partitions(spark):
        asked = asked.repartition(buckets, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "block long, kind int, data binary")
    known = answers.groupBy("block").applyInArrow(_of_block, "k long, keys binary")
    known = scratch.table(known)
    # rows of one id may stand in several blocks
    known = known.groupBy("k").agg(F.collect_list("keys").alias("keys"))
    cut = map_batches(texts.join(known, "k"), "bucket long, piece binary, p long, q long, k long, h long, at int", _cut_pieces, "t")
    cut = scratch.table(cut)
    pieces = scratch.table(cut.groupBy("bucket", "p", "q", "piece").agg(F.min("k").alias("low"), F.max("k").alias("high")))
    of_owners = scratch.table(pieces.groupBy("bucket").agg(F.sum(F.length("piece")).alias("bytes")))
    heavy = scratch.table(of_owners.where(F.col("bytes") > OWNER_BYTES).select("bucket"))
    found = _owned(pieces.join(scratch.hint(heavy), "bucket", "left_anti"), int(of_owners.agg(F.sum("bytes")).first()[0] or 0), scratch)
    if heavy.take(1):
        parts = map_batches(
            pieces.join(scratch.hint(heavy), "bucket", "left_semi").select("p", "q", "low", "high", "piece"),
            "bucket long, piece binary, p long, q long, of_p long, of_q long, at int, low long, high long",
            _cut_by_gram,
            "piece",
        )
        parts = scratch.table(parts)
        again = parts.groupBy("bucket", "p", "q", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        owned = _owned(again, int(parts.agg(F.sum(F.length("piece"))).first()[0] or 0), scratch)
        shifted = lambda c: F.transform(c, lambda x: (x + F.col("at")).cast("int")).alias(c)
        owned = parts.select("p", "q", "of_p", "of_q", "at").join(owned, ["p", "q"])
        found = found.union(owned.select("of_p", "of_q", shifted("begins"), shifted("ends"), "owners"))
    found = cut.select("p", "q", "k", "h", "at").join(found, ["p", "q"])
    found = found.select("k", "h", "at", F.explode(F.arrays_zip("begins", "ends", "owners")).alias("x")).where("x.owners < k")
    begin, end = F.col("at") + F.col("x.begins"), F.col("at") + F.col("x.ends") + (LENGTH - 1)
    return whole.union(found.select("k", "h", begin.alias("begin"), end.alias("end")))


def _kept(raw: bytes, begin: list[int], end: list[int]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and the bytes left."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin, end)):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    left, at = [], 0
    for a, b in runs:
        left.append(raw[at:a])
        at = b
    return runs, b"".join([*left, raw[at:]])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the bytes left), or its SHA-256."""
    scratch = Scratch(df.sparkSession, "substrings")
    docs = df.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    marks = repeated(docs, scratch).groupBy("k", "h").agg(F.collect_list(F.struct("begin", "end")).alias("m"))
    marks = scratch.table(marks.select("k", "h", F.col("m.begin").alias("a"), F.col("m.end").alias("b")))
    rows = docs.join(marks, ["k", "h"], "left").select("k", "t", "a", "b")

    def work(r: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in (id_col, "n_bytes", "n_removed", "n_spans", "kept")}
        for k, t, a, b in zip(r["k"], r["t"], r["a"], r["b"]):
            raw = t.encode()
            runs, left = _kept(raw, a or [], b or [])
            for c, v in zip(out, (k, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest() if digest else left)):
                out[c].append(v)
        if digest:
            out["kept_sha256"] = out["kept"]
        return out

    last = "kept_sha256 string" if digest else "kept binary"
    return map_batches(rows, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, {last}", work, "t")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(load(spark, sf_dir, "documents"), digest=True)


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
i AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS i FROM d),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * LENGTH}) AS g FROM i),
f AS (SELECT g, min(doc_id) AS owner FROM w GROUP BY g),
h AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (g) WHERE owner < doc_id),
n AS (SELECT doc_id, i, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM n GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM r),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*)::BIGINT AS spans, max(b) AS last, string_agg(substr(x, 2 * from_ + 1,
2 * (a - from_)), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
