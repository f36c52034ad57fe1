"""Connected components of a large edge table by alternating star steps.

Each round hooks every node's larger neighbours to its smallest one (large star),
then its smaller neighbours (small star), until no edge changes. A node's smallest
neighbour is a partial aggregate, and edges meet it by a plain join, so a node with
very many edges splits. Edges live in scratch tables; only two numbers a round (count
and checksum) come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v). Large star: each node hands its larger neighbours to the
    smallest of itself and its neighbours. Small star: its smaller neighbours and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
                  .unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (u, v): the smallest node it
    reaches. Nodes must not be null; loops and repeated edges are allowed."""
    now = scratch(edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = scratch(_star(_star(now, True), False), "star")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    # a fixed point is a set of stars: every node points at its component's smallest
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")) \
              .unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
