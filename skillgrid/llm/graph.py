"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component, the least id reachable, for all nodes of the undirected edges
    (u, v). Each round costs a few shuffles of the edges and is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. No task
    gathers a node's neighbours: minima are combined on the map side, and joins back to
    them can be split where a node has very many."""
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        now = scratch.table(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
