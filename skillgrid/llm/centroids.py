"""Centroid clustering in rounds, with grouped bounds that spare distance computations.

Vectors become integers (floor(scale * x)), so that distances, means and ties are exact.
The centroids are cut into a few groups once. Each vector keeps an upper bound of the
distance to its own centroid and, for each group, a lower bound of the distance to the
group's other centroids. After a round the bounds move by what the centroids moved. A
vector whose upper bound lies under all lower bounds stays where it is (the global
filter); else its upper bound is made exact, groups whose lower bound still lies above it
are left out (the group filter), and the centroids of the other groups are scanned
exactly. Bounds are floating point, so they count with a margin and ties are always scanned.

The state (vector, cluster, bounds) is a table in the shared folder, written once a round;
the one before goes as soon as the next stands. The sums of the clusters change by the
vectors that moved, summed by Spark; the driver holds the centroids only: k times the
dimensions, which the caller chooses.

Vectors that are null, of another length, or hold a null, NaN or infinite component do not
take part. Repeated rows count once each; of equal hashes (repeated ids) the smaller vector
comes first, and rows without an id are the last to become a first centroid. Fewer vectors
than k give fewer clusters, an empty table no rows. A component beyond MOST after scaling
is an error, as its distances exceed 64 bits. Only the id and the vector are read, whatever
other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, hand_back, load, reach

#: Greatest absolute component for which a distance of 64 components fits 64 bits.
MOST = 1 << 27
#: Components up to here keep products of the floating-point kind exact.
EXACT = 1 << 20
#: Relative and absolute room that bounds leave for rounding.
ROOM, LEAST_ROOM = 1e-9, 1e-6
#: Centroids of a group, about.
GROUP = 4


@dataclass
class Step:
    """What a round needs: the centroids, their groups, and how far they have moved."""

    centroids: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.group.max()) + 1

    def between(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of all vectors to the centroids `which`, exact."""
        c = self.centroids[which]
        if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
            a, b = x.astype(np.float64), c.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
        return np.stack([((x - one) ** 2).sum(1) for one in c], 1)

    def to_own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[cluster]) ** 2).sum(1)

    def scan_all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number), upper bounds, lower bounds by group."""
        d = self.between(x, np.arange(len(self.centroids)))
        cluster = d.argmin(1)
        rows = np.arange(len(x))
        upper = np.sqrt(d[rows, cluster])
        return cluster, upper, self._lower(d, cluster)

    def _lower(self, d: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        rest = np.sqrt(d)
        rest[np.arange(len(d)), cluster] = np.inf
        return np.stack([rest[:, self.group == g].min(1) for g in range(self.groups)], 1) if len(d) else np.empty((0, self.groups))

    def advance(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster and bounds after the centroids moved, and how many distances that took."""
        cluster, taken = cluster.copy(), 0
        upper = (upper + self.moved[cluster]) * (1 + ROOM) + LEAST_ROOM
        drift = np.array([self.moved[self.group == g].max() for g in range(self.groups)])
        lower = (lower - drift) * np.where(lower > drift, 1 - ROOM, 1 + ROOM) - LEAST_ROOM
        near = np.flatnonzero(lower.min(1) <= upper)  # the global filter
        if not len(near):
            return cluster, upper, lower, taken
        at, part = x[near], lower[near]
        before = cluster[near]
        best = self.to_own(at, before)
        taken += len(near)
        own = np.sqrt(best)
        chosen, still = before.copy(), own * (1 + ROOM) + LEAST_ROOM
        open_ = part <= still[:, None]  # the group filter
        own_group = self.group[before]
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in range(self.groups):
            rows = np.flatnonzero(open_[:, g])
            which = np.flatnonzero(self.group == g)
            if not len(rows):
                continue
            d = self.between(at[rows], which)
            taken += d.size
            held[g] = rows, d
            place = d.argmin(1)
            least, number = d[np.arange(len(rows)), place], which[place]
            better = (least < best[rows]) | ((least == best[rows]) & (number < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = least[better], number[better]
        for g, (rows, d) in held.items():
            which = np.flatnonzero(self.group == g)
            rest = np.sqrt(d)
            rest[which[None] == chosen[rows][:, None]] = np.inf
            part[rows, g] = rest.min(1)
        # a centroid that was left counts in its group's bound, scanned or not
        left = np.flatnonzero(chosen != before)
        part[left, own_group[left]] = np.minimum(part[left, own_group[left]], own[left])
        cluster[near], upper[near], lower[near] = chosen, np.sqrt(best), part
        return cluster, upper, lower, taken


def grouped(centroids: np.ndarray, size: int = GROUP, rounds: int = 5) -> np.ndarray:
    """A group for each centroid, by a few rounds of means over the centroids themselves."""
    k = len(centroids)
    n = max(1, -(-k // size))
    c = centroids.astype(np.float64)
    middle = c[np.linspace(0, k - 1, n).astype(int)] if k else c
    group = np.zeros(k, np.int64)
    for _ in range(rounds if n > 1 else 0):
        group = ((c[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (group == g).any():
                middle[g] = c[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


def _vectors(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.names.index(name))
    return np.asarray(column.flatten()).reshape(len(column), dims)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), kind))


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id and x, the integers of the vectors that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where((F.size("v") == dims) & ~F.exists("v", odd))
    far = F.exists("v", lambda x: F.abs(x * scale) > MOST)
    whole = F.transform("v", lambda x: F.floor(x * scale))
    return rows.select("id", F.when(far, F.raise_error(F.lit(f"a component beyond {MOST} after scaling"))).otherwise(whole).alias("x"))


def _sums(rows: DataFrame, key: Column, sign: Column, dims: int) -> dict[int, list[int]]:
    """Sums of sign and of sign times each component by key; a row for each cluster."""
    parts = [F.sum(F.col("sign") * F.col("x")[i]).alias(f"s{i}") for i in range(dims)]
    found = rows.select(key.alias("at"), sign.alias("sign"), "x").groupBy("at").agg(F.sum("sign").alias("n"), *parts)
    return {r["at"]: [r["n"], *(r[f"s{i}"] for i in range(dims))] for r in found.collect()}


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3,
) -> tuple[DataFrame, list[list[int]]]:
    """`id_col`, x (the integers), cluster and distance (squared) of the vectors that take
    part, and the final centroids. The first centroids are the k vectors with the smallest
    SHA-256 of "seed:id"."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    scratch, other = Scratch(spark, "vectors"), Scratch(spark, "vectors")
    state = scratch.table(kept_vectors(df, id_col, vector_col, dims, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.orderBy(digest.asc_nulls_last(), "x").select("x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dims)
    group, moved = grouped(centroids), np.zeros(len(first))
    sums = [[0] * (dims + 1) for _ in first]
    groups = int(group.max(initial=0)) + 1
    shape = f"id {kinds[id_col]}, x array<bigint>, cluster int, prior int, upper double, lower array<double>"
    reach(spark)
    for turn in range(rounds + 1 if first else 0):
        step, last = Step(centroids, group, moved), turn == rounds
        fresh = turn == 0

        def assign(batches: Iterator[pa.RecordBatch], step: Step = step, fresh: bool = fresh) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                x = _vectors(batch, "x", dims)
                if fresh:
                    prior = np.full(len(x), -1)
                    now, upper, lower = step.scan_all(x)
                else:
                    prior, upper = (np.asarray(batch.column(c)) for c in ("cluster", "upper"))
                    now, upper, lower, _ = step.advance(x, prior, upper, _vectors(batch, "lower", groups))
                columns = [batch.column(0), batch.column(1), pa.array(now, pa.int32()), pa.array(prior, pa.int32()), pa.array(upper), _lists(lower, pa.float64())]
                names = ["id", "x", "cluster", "prior", "upper", "lower"]
                out = pa.RecordBatch.from_arrays(columns, names=names)
                yield out
            hand_back()

        columns = ["id", "x"] if fresh else ["id", "x", "cluster", "upper", "lower"]
        state = other.table(state.select(*columns).mapInArrow(assign, shape))
        scratch.drop()
        scratch, other = other, Scratch(spark, "vectors")
        if last:
            break
        went = state.where("cluster <> prior")
        # a vector that moved adds to one cluster and leaves another
        went = went.select("x", F.explode(F.array(F.struct(F.col("cluster").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("prior").alias("at"), F.lit(-1).alias("sign")))).alias("m"))
        for at, change in _sums(went.where("m.at >= 0"), F.col("m.at"), F.col("m.sign").cast("long"), dims).items():
            sums[at] = [a + b for a, b in zip(sums[at], change)]
        fresh_centroids = np.array([[s // n[0] for s in n[1:]] if n[0] else list(map(int, old)) for n, old in zip(sums, centroids)], np.int64)
        moved = np.sqrt(((fresh_centroids - centroids) ** 2).sum(1).astype(np.float64)) * (1 + ROOM)
        centroids = fresh_centroids
    if not first:
        state = state.select("id", "x", F.lit(None).cast("int").alias("cluster"))
    final = Step(centroids, group, moved)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(2))
            d = final.to_own(_vectors(batch, "x", dims), own) if len(own) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int64())], names=["id", "x", "cluster", "distance"])

    out = state.select("id", "x", "cluster").mapInArrow(measure, f"id {kinds[id_col]}, x array<bigint>, cluster int, distance bigint")
    return out.withColumnRenamed("id", id_col), [list(map(int, c)) for c in centroids]


def with_inertia(clustered: DataFrame, centroids: list[list[int]], id_col: str = "vec_id") -> DataFrame:
    """`id_col`, cluster, distance, the sums of distance over the cluster and over all, and
    the digest of the cluster's centroid. The joined table has a row for each centroid."""
    spark = clustered.sparkSession
    rows = Scratch(spark, "clusters").table(clustered.select(id_col, "cluster", "distance"))
    sums = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}
    total = sum(sums.values())
    told = [(i, sums.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(load(spark, sf_dir, "embeddings")))


def _oracle(k: int = 8, rounds: int = 10) -> str:
    """The plain definition: all distances in each round."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 "
        "AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "e AS MATERIALIZED (SELECT vec_id, i, x[i] AS q FROM v, range(1, 65) AS r(i))",
        f"c0 AS MATERIALIZED (SELECT c, i, x[i] AS q FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k}), range(1, 65) AS r(i))",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"a{t} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((e.q - m.q) * (e.q - m.q))::BIGINT AS d "
            f"FROM e JOIN c{t} m USING (i) GROUP BY vec_id, c) GROUP BY vec_id)"
        )
        if t < rounds:
            parts.append(
                f"c{t + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(n.q, o.q) AS q FROM c{t} o LEFT JOIN (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS q FROM "
                f"(SELECT a.c, e.i, sum(e.q) AS s, count(*) AS n FROM a{t} a JOIN e USING (vec_id) GROUP BY a.c, e.i)) n USING (c, i))"
            )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, "
        f"(sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} a JOIN (SELECT c, sha256(string_agg(q::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"
    )


ORACLE = _oracle()
