"""Connected components of an edge table by random-priority contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b: bigint) to (node, root): root is the smallest node reachable.

    Only nodes that stand in an edge with another node are returned; loops, repeated edges and
    nulls are ignored. Each round every node moves to its neighbour of least hashed priority and
    the edges are mapped along, so even a long chain shrinks by a constant share a round. A hub
    only ever meets partial minima, never a collected list, and joins on it can be split by AQE.
    """
    a, b = F.col("a"), F.col("b")
    tidy = lambda df: df.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left, steps = scratch.save(tidy(edges), "edges"), []
    while not left.isEmpty():
        salt = F.lit(len(steps))
        ends = left.select(F.explode(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v")))).alias("e")).select("e.u", "e.v")
        near = ends.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", salt).alias("p"), F.col("v"))).alias("m"))
        own = F.struct(F.xxhash64("u", salt).alias("p"), F.col("u").alias("v"))
        step = scratch.save(near.select("u", F.least("m", own).getField("v").alias("to")), "step")
        steps.append(step)
        moved = left.join(step.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        left = scratch.save(tidy(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    place = steps[-1]
    for step in reversed(steps[:-1]):
        later = place.select(F.col("u").alias("to"), F.col("to").alias("last"))
        place = scratch.save(step.join(later, "to", "left").select("u", F.coalesce("last", "to").alias("to")), "place")
    # a node that was contracted away in the first round is a row of the first step, so place has all nodes
    least = place.groupBy("to").agg(F.min("u").alias("root"))
    return scratch.save(place.join(least, "to").select(F.col("u").alias("node"), "root"), "components")
