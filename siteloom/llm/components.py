"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node's edges meet its smallest neighbour in so many tasks.
LOTS = 16


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v). Each node's smallest neighbour (or itself) is an aggregate, joined back to
    the node's edges in lots, so a node with very many neighbours is gathered neither in a row nor in a task."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    dealt = both.withColumn("lot", F.pmod(F.xxhash64("y"), F.lit(LOTS)))
    joined = dealt.join(least.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOTS - 1).cast("long")))), ["x", "lot"]).drop("lot")
    if large:
        moved = joined.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of ``edges`` (u, v), any direction, repeats allowed.

    Large and small stars alternate, each step written out, until a pair of steps changes nothing (compared by
    count and hash sum, the only numbers that reach the driver); then every edge leads to its root. That they settle,
    in about the logarithm of the longest path, is proven; no number of rounds is set. No edges, no rows.
    """
    state = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "edges")
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(state)
    while True:
        large = _stars(state, True)
        small = materialize(_stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), False), "edges")
        discard(state)
        state, now = small, sign(small)
        if now == before:
            break
        before = now
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
