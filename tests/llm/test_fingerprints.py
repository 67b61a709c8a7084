import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skillgrid.llm import fingerprints as P

from .data import empty_documents, odd_documents, words


def slow_chunks(raw: bytes) -> list[tuple[int, int]]:
    """One byte at a time, from the definition."""
    out, begin, h = [], 0, 0
    seen = [0] * len(raw)
    for i, b in enumerate(raw):
        h = (h << 1) + int(P.GEAR[b]) & 0xFFFFFFFF
        seen[i] = h
    while begin < len(raw):
        end = min(begin + P.MAX, len(raw))
        for i in range(begin + P.MIN - 1, end):
            bits = P.STRICT if i < begin + P.NORMAL - 1 else P.LOOSE
            if seen[i] >> (32 - bits) == 0:
                end = i + 1
                break
        out.append((begin, end))
        begin = end
    return out


def test_chunks_equal_the_definition():
    rng = random.Random(3)
    blobs = [words(rng, n).encode() for n in (0, 1, 3, 40, 500)] + [b"", b"a" * 1000, "é\U0001f642".encode() * 99]
    flat, owner, a, b = P.chunk_spans(blobs)
    got = [[] for _ in blobs]
    for o, i, j in zip(owner.tolist(), a.tolist(), b.tolist()):
        got[o].append(flat[i:j])
    assert [b"".join(x) for x in got] == blobs
    assert [[raw[i:j] for i, j in slow_chunks(raw)] for raw in blobs] == got


def test_insertion_moves_few_chunks():
    rng = random.Random(4)
    text = words(rng, 400).encode()
    p = P.Prints([text, text[:50] + b"some words more " + text[50:]])
    assert P.likeness(p, p, 1)[0] > 0.9
    q = P.Prints([words(rng, 400).encode()])
    assert P.likeness(p, q)[0] < 0.05


def test_likeness_of_empty_sets():
    p = P.Prints([b"", b"", b"abc"])
    assert P.likeness(p, p).tolist() == [1, 1, 1] and P.likeness(p, p, 1).tolist() == [1, 0] and p.strings()[0] == ""


@pytest.mark.parametrize("extra", [True, False])
def test_successive_edits(spark, extra):
    df = odd_documents(spark, extra=extra)
    rows = sorted(((-1 << 63 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["doc_id"]) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (_, a, k) in enumerate(rows):
        b = rows[(i + 1) % len(rows)][1]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        p = P.Prints([a.encode(), edited.encode(), b.encode()])
        want.append((k, len(a), hashlib.sha256(edited.encode()).hexdigest(), p.strings()[0], p.strings()[1], P.likeness(p, p, 1)[0], P.likeness(P.Prints([a.encode()]), P.Prints([b.encode()]))[0]))
    key = lambda r: str(r)
    got = [tuple(r) for r in P.successive_edits(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "hello world")], "doc_id long, text string")
    row = P.successive_edits(one).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"hello hello").hexdigest()
    assert P.successive_edits(empty_documents(spark)).count() == 0
    assert P.fingerprint(empty_documents(spark)).count() == 0
    assert P.fingerprint(odd_documents(spark)).count() == odd_documents(spark).count()


def test_rows_of_one_id_spread(spark, monkeypatch):
    rng = random.Random(9)
    texts = sorted(words(rng, 6) for _ in range(20_000))
    rows = [(None, t) for t in texts] + [(i, f"text {i}") for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    keyed = df.select(F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("o"), F.col("text").alias("t"), F.substring("text", 1, P.PREFIX).alias("p"))
    bounds, tasks = P._bounds(keyed)
    sizes = [r["count"] for r in keyed.groupBy(P._range_of(bounds).alias("r")).count().collect()]
    assert tasks == 4 and len(sizes) == len(bounds) >= 4 * tasks and max(sizes) < len(rows) / 4
    got = P.successive_edits(df)
    # ids come down, null ids last and by text; after the last row comes the first
    order = [t for _, t in sorted((r for r in rows if r[0] is not None), reverse=True, key=lambda r: r[0])] + texts
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(order, order[1:] + order[:1])]
    assert sorted(r[0] for r in got.select("edited_sha256").collect()) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in edited)
    monkeypatch.setattr(P, "TASK_BYTES", 20_000)
    assert P._bounds(keyed)[1] > 20
    assert P.successive_edits(df).exceptAll(got).isEmpty()
