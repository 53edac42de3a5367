"""Connected components of a graph of any size, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b); a component is its smallest node.

    Each round links every node's larger neighbours, then all of its smaller ones, to the smallest it
    knows; a round is two joins on small rows, and rounds grow with the logarithm of the longest path. Minima
    combine in the tasks before they shuffle, and AQE splits the joins where a node has very many links.
    """
    now = ws.save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark, i = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        i += 1
        after = ws.save(small, f"{name}-{i}")
        r = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if (r[0], r[1]) == mark:
            break
        ws.drop(f"{name}-{i - 1}")
        now, mark = after, (r[0], r[1])
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return ws.save(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), f"{name}-labels")
