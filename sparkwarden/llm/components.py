"""Connected components by alternating large and small stars (Kiveris et al.), each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lookup, small, written


def _starred(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over edges (u, v), u > v: each node's chosen neighbours are linked to the least one. Nodes of many edges are joined by broadcast."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"), F.count("*").alias("degree"))
    joined = both.join(F.broadcast(least.drop("degree")), "n") if total <= BROADCAST_ROWS else lookup(both, least, "n", "degree", 2 * total if large else total)
    if large:
        out = joined.where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("low").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, ...]:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.col("u") % (1 << 40))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for each node with an edge; edges go either way."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "edges")
    before, state = None, _state(now)
    while state[0] and state != before:
        now = written(_starred(written(_starred(now, True, state[0]), "large"), False, state[0]), "small")
        before, state = state, _state(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(of: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """of (node, component) with further edges: only components that they join are looked at."""
    at = lambda x: of.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(small(at("a")), "a", "left").join(small(at("b")), "b", "left")
    pairs = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    pairs = written(pairs, "joins")
    if pairs.isEmpty():
        return of
    new = written(components(pairs).withColumnRenamed("component", "to").withColumnRenamed("node", "from"), "joined")
    moved = of.join(small(new), F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = new.join(small(of.select("node")), F.col("from") == F.col("node"), "left_anti").select(F.col("from").alias("node"), F.col("to").alias("component"))
    return written(moved.unionByName(alone), "components")
