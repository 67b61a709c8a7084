import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import substrings as S

from .data import empty_documents, odd_documents, words


def brute(rows, n=50):
    first = {}
    for k, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - n + 1 if k is not None else 0):
            w = raw[i : i + n]
            first[w] = min(k, first.get(w, k))
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1 if k is not None else 0):
            if first[raw[i : i + n]] < k:
                gone[i : i + n] = b"\1" * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in S.dedup(df, digest=True).collect()), key=str)


def test_owners_equal_a_dictionary():
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab ") for _ in range(400))
    pieces = list({base[a : a + rng.randint(50, 160)] for a in (rng.randint(0, 340) for _ in range(60))})
    pieces = [p for p in pieces if len(p) >= 50] + [b"a" * 90, b"ab" * 40]
    docs = np.array([rng.randint(0, 40) for _ in pieces])
    least = {}
    for p, k in zip(pieces, docs):
        for i in range(len(p) - 49):
            least[p[i : i + 50]] = min(k, least.get(p[i : i + 50], k))
    for p, own in zip(pieces, S.owners(pieces, docs)):
        assert own.tolist() == [least[p[i : i + 50]] for i in range(len(p) - 49)]


@pytest.mark.parametrize("length", [1, 3, 7, 20])
def test_extension_finds_the_common_prefixes(length):
    rng = np.random.default_rng(length)
    text = np.concatenate((rng.integers(97, 100, 300), np.full(64, 255))).astype(np.uint8)
    order = S.sort_suffixes(text)
    raw = text.tobytes() * 2
    want = [raw[a : a + length] != raw[b : b + length] for a, b in zip(order, order[1:])]
    assert S.separated(text, order, length)[1:-1].tolist() == want


def test_grams_cover_all_windows_and_depend_on_them_only():
    rng = random.Random(2)
    same = words(rng, 30).encode()
    blobs = [b"", b"x" * 49, b"y" * 50, words(rng, 50).encode() + same, same + words(rng, 5).encode()]
    keys = {}
    seen = [0] * len(blobs)
    for blob, start, count, key in zip(*(x.tolist() for x in S.grams(blobs))):
        for i in range(start, start + count):
            assert keys.setdefault(blobs[blob][i : i + 50], key) == key
            seen[blob] += 1
    assert seen == [max(0, len(b) - 49) for b in blobs]


@pytest.mark.parametrize("frequent,rows", [(S.FREQUENT, S.BLOCK_ROWS), (3, 2)])
def test_odd_rows_equal_brute_force(spark, monkeypatch, frequent, rows):
    """The second pair sends frequent grams once a block and deals windows by content."""
    monkeypatch.setattr(S, "FREQUENT", frequent)
    monkeypatch.setattr(S, "BLOCK_ROWS", rows)
    rng = random.Random(7)
    passage, long = words(rng, 25), words(rng, 300)
    more = [(100 + i, f"{words(rng, rng.randint(0, 12))} {passage} {words(rng, rng.randint(0, 12))}") for i in range(40)]
    more += [(200 + i, long[i * 7 : i * 7 + 700] + words(rng, 3)) for i in range(8)] + [(300, "ab" * 200), (301, "ba" * 60), (302, "é" * 100)]
    df = odd_documents(spark)
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert got(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_many_buckets_and_one_hot_owner(spark, monkeypatch):
    """A third of the rows share one owner; its pieces are cut by gram, buckets are many and
    groups small, and the result is the same. No group is far over its bytes."""
    rng = random.Random(9)
    base = words(rng, 400)
    rows = [(0, base)] + [(i, f"{words(rng, 4)} {base[(a := rng.randint(0, 1200)) : a + rng.randint(60, 900)]} {words(rng, 4)}") for i in range(1, 60)]
    rows += [(100 + i, words(rng, rng.randint(1, 60))) for i in range(100)] + [(300 + i, words(rng, 5) + base[:80]) for i in range(20)]
    rows += [(500, rows[120][1]), (501, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    want = brute(rows)
    monkeypatch.setattr(S, "GROUP_BYTES", 2000)
    monkeypatch.setattr(S, "BUCKET_BYTES", 500)
    groups = []

    def counted(pieces, total, scratch, own=S._owned):
        sizes = pieces.groupBy((F.pmod("bucket", F.lit(max(1, -(-total // S.GROUP_BYTES))))).alias("g")).agg(F.sum(F.length("piece")).alias("b"))
        groups.append(sizes.agg(F.max("b")).first()[0] or 0)
        return own(pieces, total, scratch)

    monkeypatch.setattr(S, "_owned", counted)
    assert got(df) == want
    whole = max(groups)
    groups.clear()
    monkeypatch.setattr(S, "OWNER_BYTES", 1000)
    assert got(df) == want
    assert len(groups) == 2 and max(groups) < whole / 2


def test_kept_bytes(spark):
    rng = random.Random(3)
    a = words(rng, 40)
    out = {r["doc_id"]: r["kept"] for r in S.dedup(spark.createDataFrame([(1, a), (2, "new " + a + " end")], "doc_id long, text string")).collect()}
    assert bytes(out[1]) == a.encode() and bytes(out[2]) == b"new  end"


def test_no_rows(spark):
    assert got(empty_documents(spark)) == []
