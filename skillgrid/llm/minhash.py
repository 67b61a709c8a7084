"""Near-duplicate documents: MinHash, banding, verification, connected components.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a document's
set has its distinct shingles of `size` words, or its whole sequence if that is shorter.
Documents with equal sets form a class, whose member with the least id stands for it.
Each class gets BANDS x ROWS minima of universal hashes, and the minima of a band make a
bucket key. A pair at the similarity asked for shares no bucket with a chance of
(1 - 0.8 ** ROWS) ** BANDS, under one in two million.

Within a bucket not all pairs are compared. First each class is compared with the least
class of one of its buckets, then with the least ones of its other buckets, where these
are not in its component yet. Strays, which are still in another component than the
least class of a bucket of theirs, are compared with the classes there: in small buckets
with all near enough in size, in large ones with those that differ from the least class
in the same shingles (see _far_pairs). So a bucket of
copies costs its size, what many documents share makes no pairs, and no link is lost. Links count only if the full
sets confirm them.

Documents without words (or null texts) have the size 0 and are linked with nothing;
null ids are neither linked nor given a component. Rows with equal ids are one document.
A similarity of exactly `percent` links. Sets of very long texts are whole. An empty table
gives no rows; only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, load, map_batches, shuffle_partitions
from .graph import components

SIZE, PERCENT = 5, 80
BANDS, ROWS = 48, 6
#: Buckets with up to this product of strays and members compare their strays pair by pair.
SMALL = 1024
SEED = 0x5EED


def _odd(n: int, seed: int, kind: type) -> np.ndarray:
    bits = np.dtype(kind).itemsize * 8
    return np.random.default_rng(seed).integers(0, 1 << (bits - 1), n, np.uint64).astype(kind) * kind(2) + kind(1)


MULTIPLY, ADD = _odd(BANDS * ROWS, SEED, np.uint32), _odd(BANDS * ROWS, SEED + 1, np.uint32)
_BAND = _odd(ROWS, SEED + 2, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [(t or "").encode().lower().split() for t in texts]
    n = [len(w) for w in words]
    digest = xxhash.xxh3_64_intdigest
    flat = np.fromiter((h for w in words for h in map(digest, w)), np.uint64, sum(n))
    flat = np.concatenate((flat, np.zeros(size, np.uint64)))
    factor = _odd(size, SEED + 3, np.uint64)
    total = len(flat) - size
    hashes = flat[:total] * factor[0]
    for k in range(1, size):
        hashes += flat[k : k + total] * factor[k]
    hashes = _mix(hashes)
    out, at = [], 0
    for m in n:
        if m >= size:
            h = np.sort(hashes[at : at + m - size + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif m:
            out.append(_mix((flat[at : at + m] * factor[:m]).sum(keepdims=True) + np.uint64(m)))
        else:
            out.append(hashes[:0])
        at += m
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket keys (set, band)."""
    minima = np.zeros((len(sets), BANDS * ROWS), np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        least = None
        for a in range(0, len(x), 1024):
            part = np.multiply.outer(MULTIPLY, x[a : a + 1024])
            part += ADD[:, None]
            low = part.min(1)
            least = low if least is None else np.minimum(least, low)
        if least is not None:
            minima[i] = least
    keys = (minima.reshape(len(sets), BANDS, ROWS).astype(np.uint64) * _BAND).sum(2, dtype=np.uint64)
    return _mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def work(rows: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(rows["t"], size)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        whole = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return {"k": rows["k"], "n": [len(s) for s in sets], "a": whole[:, 0], "b": whole[:, 1], "keys": list(band_keys(sets).astype(np.int64))}

    return map_batches(docs, "k long, n long, a long, b long, keys array<long>", work, "t")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def work(rows: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(rows["t"], size)
        return {"k": rows["k"], "n": list(map(len, sets)), "s": [x.astype(np.int64) for x in sets]}

    return map_batches(docs, "k long, n long, s array<long>", work, "t")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, their set sizes and the size of the intersection, on full sets."""
    of = lambda x: sets.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_u", "s_v")).cast("long").alias("both")
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "n_u", "n_v", both)


def _edge(a: str, b: str) -> tuple[Column, Column]:
    """The larger of two columns of ids as u, the smaller as v."""
    return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")


def _similar(percent: int):
    return 100 * F.col("both") >= percent * (F.col("n_u") + F.col("n_v") - F.col("both"))


def _pairs(s: DataFrame, o: DataFrame, on: list[str], percent: int, also: Column | None = None) -> DataFrame:
    """u, v from rows of strays s and others o that agree on `on`, are in different
    components, and have sets near enough in size."""
    s, o = s.alias("s"), o.alias("o")
    cond = (F.col("s.c") != F.col("o.c")) & (100 * F.col("s.n") >= percent * F.col("o.n")) & (100 * F.col("o.n") >= percent * F.col("s.n"))
    cond = cond & ((F.col("o.stray") == 0) | (F.col("s.k") < F.col("o.k")))
    cond = cond if also is None else cond & also
    for c in on:
        cond = cond & (F.col(f"s.{c}") == F.col(f"o.{c}"))
    return s.join(o, cond).select(*_edge("s.k", "o.k"))


def _far_pairs(left: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links of members of large buckets to a reference, and pairs that are left.

    `left` has k, c, n, stray and the reference r, the least document of the component
    from which k strays, or its own. With D(k) the difference of the sets of k and r (both
    ways), the sets of s and o differ in D(s) + D(o) - 2 |D(s) & D(o)| shingles, and are
    similar if that is at most (n(s) + n(o)) (100 - p) / (100 + p). If D(s) + D(o) is no
    more, both are similar to r itself. Else their differences need common shingles, so
    many that already the first common one must come early in an order of all, from
    rare to frequent (the position filter). What all share with r makes no pairs at all, nor
    does a difference that many share, unless a row has hardly a rarer one. Pairs are thus
    bounded by those of one component's strays that begin with the same rare difference."""
    of = lambda x, s: sets.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(s))
    rows = left.where("k <> r").join(of("k", "a").drop("n_k"), "k").join(of("r", "b"), "r")
    rows = rows.withColumn("gained", F.array_except("a", "b")).withColumn("lost", F.array_except("b", "a"))
    rows = scratch.table(rows.select("k", "c", "n", "stray", "r", "n_r", "gained", "lost").withColumn("dn", F.size("gained") + F.size("lost")))
    links = rows.where((100 + percent) * F.col("dn") <= (100 - percent) * (F.col("n") + F.col("n_r")))
    links = links.where("stray = 1").select(*_edge("k", "r"))
    # the shingles that a sixteenth of r's rows have: at most sixteen times what a row has;
    # they only order the shingles (any order is right), so every fourth row tells enough
    rows = rows.withColumn("d", F.concat("gained", "lost"))
    told = rows.where(F.pmod(F.xxhash64("k"), F.lit(4)) == 0)
    often = told.select("r", F.explode("d").alias("x")).groupBy("r", "x").agg(F.count("*").alias("f")).where("f > 1").alias("f")
    many = told.groupBy("r").agg(F.count("*").alias("m")).alias("m")
    often = often.join(many, (F.col("f.r") == F.col("m.r")) & (16 * F.col("f.f") >= F.col("m.m"))).select("f.r", "x", "f")
    often = often.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("x", "f"))).alias("f"))
    # broadcast if it is small, so that a reference with many rows stays dealt out
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "k")
    each = dealt.join(scratch.hint(scratch.table(often)), "r", "left")
    counted = F.transform("d", lambda x: F.struct(F.coalesce(F.element_at("f", x), F.lit(0)).alias("f"), x.alias("x")))
    each = each.withColumn("d", F.array_sort(counted).getField("x"))
    # no partner (of at most 100 / p times the size) has its first common shingle further on
    front = F.slice("d", 1, F.floor(F.col("n") * (100 - percent) / percent).cast("int") + 1)
    each = each.select("k", "c", "n", "stray", "r", "dn", F.posexplode(front).alias("i", "x"))
    most = F.least(F.col("s.dn") - F.col("s.i"), F.col("o.dn") - F.col("o.i"))
    early = (100 + percent) * (2 * most - F.col("s.dn") - F.col("o.dn")) + (100 - percent) * (F.col("s.n") + F.col("o.n")) >= 0
    return links, _pairs(each.where("stray = 1"), each, ["r", "x"], percent, early).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of df: id, n_shingles, component_id and kept."""
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    signs = scratch.table(_signatures(docs, size))
    classes = scratch.table(signs.where("n > 0 and k is not null").groupBy("a", "b", "n").agg(F.min("k").alias("rep")))
    heads = signs.join(classes.select(F.col("rep").alias("k"), "a", "b"), ["k", "a", "b"]).select("k", "n", F.explode("keys").alias("key")).distinct()
    least = heads.groupBy("key").agg(F.min("k").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("key", "pivot")
    members = scratch.table(heads.join(least, "key"))

    ids = scratch.table(members.select("k").distinct())
    sets = scratch.table(_sets(docs.join(scratch.hint(ids), "k", "left_semi"), size))

    # each class with the pivot that most of its buckets name (ties: the least)
    votes = members.where("k <> pivot").groupBy("k", "pivot").agg(F.count("*").alias("c"))
    votes = scratch.table(votes)
    first = votes.groupBy("k").agg(F.min(F.struct(-F.col("c"), "pivot")).alias("x")).select(F.col("k").alias("u"), F.col("x.pivot").alias("v"))
    known = scratch.table(_compare(first, sets))
    links = scratch.table(known.where(_similar(percent)).select("u", "v"))
    found = scratch.table(components(links, scratch))

    def labelled(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components so far."""
        for x in ("u", "v"):
            pairs = pairs.join(scratch.hint(found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))), x, "left")
        return pairs.where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).drop("c_u", "c_v")

    # the other pivots, as far as they are in other components
    rest = labelled(votes.select(F.col("k").alias("u"), F.col("pivot").alias("v")).join(known.select("u", "v"), ["u", "v"], "left_anti"))
    more = scratch.table(_compare(rest, sets))
    fresh = more.where(_similar(percent)).select("u", "v")
    links = scratch.table(links.union(fresh))
    found = scratch.table(components(links, scratch))

    # what is left in a bucket besides the component of its pivot, against all in such buckets
    at = members.join(scratch.hint(found.select(F.col("node").alias("k"), "component")), "k", "left").withColumn("c", F.coalesce("component", "k"))
    of_pivots = found.select(F.col("node").alias("pivot"), F.col("component").alias("pc"))
    at = at.join(scratch.hint(of_pivots), "pivot", "left").withColumn("stray", (F.col("c") != F.coalesce("pc", "pivot")).cast("int"))
    at = at.select("key", "k", "n", "c", F.coalesce("pc", "pivot").alias("r"), "stray")
    at = scratch.table(at)
    # sums are combined where the rows are, and come back by a join that can be split
    work = at.groupBy("key").agg((F.sum("stray") * F.count("*")).alias("work")).where("work > 0")
    at = at.join(scratch.hint(scratch.table(work)), "key")
    small = at.where(F.col("work") <= SMALL)
    large = at.where(F.col("work") > SMALL).groupBy("k", "c", "n", "r").agg(F.max("stray").alias("stray"))
    near, far = _far_pairs(scratch.table(large), sets, percent, scratch)
    near = scratch.table(near)
    pairs = scratch.table(_pairs(small.where("stray = 1"), small, ["key"], percent).union(far).distinct())
    last = scratch.table(_compare(pairs, sets).where(_similar(percent)).select("u", "v").union(near))
    if last.take(1):
        found = scratch.table(components(links.union(last), scratch))

    named = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("a", "b", "n", F.coalesce("component", "rep").alias("component"))
    out = signs.select("k", "a", "b", "n").join(named, ["a", "b", "n"], "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("component", "k"))
    kept = F.coalesce(component == F.col("k"), F.lit(True)).alias("kept")
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), size=4)


ORACLE = """
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i:
array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(node, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.least FROM r JOIN e ON e.u = r.node WHERE r.least < e.v),
m AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING
(doc_id) JOIN m ON node = doc_id
"""
