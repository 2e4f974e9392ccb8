"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.llm.common import written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, v) edges of longs -> (node, component), component the smallest node reachable; for nodes on an edge.

    Large-star then small-star until the edges no longer change: every round hangs a node's larger neighbours
    (then its smaller ones) on its smallest neighbour. Rounds grow with the logarithm of a component's size. Each
    round is a grouped minimum (combined before the shuffle) and a join on the same key, so a hub of any degree
    is split by the skew join; every round is written to the shared folder. Loops, repeated edges and an empty
    table are allowed; edges with a null end are ignored.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
