"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import stored


def _to_lowest(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with the lowest v of each u: counted first, joined second.

    A hub's arcs stay separate rows, so Spark can split them over tasks.
    """
    low = arcs.groupBy("u").agg(F.min("v").alias("m"))
    return arcs.join(low, "u")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _to_lowest(both).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    near = _to_lowest(e)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = e.groupBy("u").agg(F.min("v").alias("v"))
    return moved.unionByName(own).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node with the smallest node it can reach.

    Only nodes with an edge to another node other than the component's own
    smallest node are returned; all others are their own component. Null ends,
    loops and repeated edges are ignored; no edges give no rows. Each round
    moves as many rows as there are edges, and rounds grow with the logarithm
    of the largest component.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and u is not null and v is not null").distinct()
    e = stored(e)
    mark = _mark(e)
    while mark[0]:
        e = stored(_small_star(_large_star(e)))
        after = _mark(e)
        if after == mark:
            break
        mark = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(e: DataFrame) -> tuple:
    """Count and order-free checksum of the arcs; 24 bits of the hash are summed, so
    that no number of arcs that can be held passes a long."""
    h = F.xxhash64("u", "v")
    r = e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 40))).first()
    return tuple(r)
