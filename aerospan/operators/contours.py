"""Lines of equal value on meshes of triangles, chained into polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.operators.arrangement import traced
from aerospan.operators.mesh import gather
from aerospan.session import stored

AXES = ["x", "y", "z"]


def crossings(elements: DataFrame, nodes: DataFrame, field: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """(elem_id, level, a, b): where a level crosses a triangle, from point ``a`` to point ``b``, with higher values on the left.

    A point is a struct of the edge (lo, hi) it lies on, lo < hi, and its place. A node at the level counts as above it, so every triangle that
    is met has two points, and one through a node may be without length. Triangles with an unknown or missing value have none.
    """
    known = nodes.select("node_id", *(F.col(c).cast("double").alias(c) for c in AXES)).join(field.select("node_id", F.col(value).cast("double").alias("f")), "node_id")
    g = gather(elements.where("ltype = 10"), known.where("f is not null and not isnan(f)"))
    t = g.groupBy("elem_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "f", *AXES))).alias("c")).where(F.size("c") == 3)
    all_f = F.transform("c", lambda s: s["f"])
    met = F.filter(F.array(*(F.lit(float(v)) for v in levels)), lambda v: (v > F.array_min(all_f)) & (v <= F.array_max(all_f)))
    t = t.select("elem_id", "c", F.explode(met).alias("level"))

    def point(k: int):
        p, q = F.get("c", F.lit(k)), F.get("c", F.lit((k + 1) % 3))
        swap = p["node_id"] > q["node_id"]
        lo, hi = F.when(swap, q).otherwise(p), F.when(swap, p).otherwise(q)
        share = (F.col("level") - lo["f"]) / (hi["f"] - lo["f"])
        at = [(lo[x] + share * (hi[x] - lo[x])).alias(x) for x in AXES]
        return F.struct(lo["node_id"].alias("lo"), hi["node_id"].alias("hi"), *at), p["f"] >= F.col("level"), q["f"] >= F.col("level")

    sides = [point(k) for k in range(3)]
    falls, rises = (F.coalesce(*(F.when((p == first) & (q != first), at) for at, p, q in sides)) for first in (True, False))
    return t.select("elem_id", "level", falls.alias("a"), rises.alias("b"))


def contour_lines(elements: DataFrame, nodes: DataFrame, field: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """(level, line, closed, pt_no, lo, hi, x, y, z): polylines of a field (node_id, value) on triangles, point by point.

    A closed line doesn't repeat its first point. Lines run with higher values on the left where triangles are numbered the same way round;
    else as their first segment does. Where more than two triangles share an edge, lines end.

    Every segment is taken both ways; a way goes on with the other segment at its end, or turns round where there is none. So all are cycles,
    which pointer jumping orders in the logarithm of the longest one's rounds: a closed line is two of them, an open one a way there and back.
    """
    seg = stored(crossings(elements, nodes, field, value, levels).withColumn("s", F.monotonically_increasing_id()))
    ahead = seg.select("level", (2 * F.col("s")).alias("h"), F.col("a").alias("p"), F.col("b").alias("q"))
    back = seg.select("level", (2 * F.col("s") + 1).alias("h"), F.col("b").alias("p"), F.col("a").alias("q"))
    half = ahead.unionByName(back)
    meets = half.select("level", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), "h").groupBy("level", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))
    ways = half.withColumn("lo", F.col("q.lo")).withColumn("hi", F.col("q.hi")).join(meets, ["level", "lo", "hi"])
    twin = F.col("h").bitwiseXOR(F.lit(1))
    other = F.when(F.col("first") == twin, F.col("last")).otherwise(F.col("first"))
    ways = stored(ways.select("level", "h", "p", "q", F.when(F.col("n") == 2, other).otherwise(twin).alias("nxt"), (F.col("n") != 2).alias("turns")))
    ranks = traced(ways.select("h", "nxt", F.lit(0).alias("ox"), F.lit(0).alias("oy")))  # a cycle is named by its least way, at 0
    ways = stored(ways.join(ranks, "h"))
    # where a way turns round, its other way starts
    starts = ways.where("turns").groupBy("cycle").agg(F.max((F.col("pos") + 1) % F.col("n")).alias("late"), F.min((F.col("pos") + 1) % F.col("n")).alias("early"))
    ways = ways.join(starts, "cycle", "left").where("cycle % 2 = 0").withColumn("closed", F.col("late").isNull())
    start = F.when(F.col("closed") | (F.col("early") == 0), 0).otherwise(F.col("late"))
    ways = ways.withColumn("pt_no", (F.col("pos") - start + F.col("n")) % F.col("n"))
    ways = ways.where(F.col("closed") | (F.col("pt_no") < F.col("n") / 2))
    last = ~F.col("closed") & (F.col("pt_no") == F.col("n") / 2 - 1)
    here = F.struct("pt_no", F.col("p").alias("at"))
    ways = ways.select("level", F.shiftright("cycle", 1).alias("line"), "closed", F.explode(F.when(last, F.array(here, F.struct((F.col("pt_no") + 1).alias("pt_no"), F.col("q").alias("at")))).otherwise(F.array(here))).alias("r"))
    return ways.select("level", "line", "closed", F.col("r.pt_no").alias("pt_no"), "r.at.*")


def lengths(lines: DataFrame) -> DataFrame:
    """(level, line, closed, points, length) of polylines; closed ones with the way back to their first point."""
    n = lines.groupBy("level", "line").agg(F.count(F.lit(1)).alias("points"))
    p = lines.join(n, ["level", "line"])
    ends = p.select("level", "line", (F.when(F.col("pt_no") == 0, F.col("points")).otherwise(F.col("pt_no")) - 1).alias("pt_no"), *(F.col(x).alias(f"_{x}") for x in AXES), (F.col("pt_no") == 0).alias("_first"))
    size = F.sqrt(sum((F.pow(F.col(x) - F.col(f"_{x}"), 2) for x in AXES), F.lit(0.0)))
    pairs = p.join(ends, ["level", "line", "pt_no"])
    return pairs.groupBy("level", "line", "closed", "points").agg(F.sum(F.when(F.col("_first") & ~F.col("closed"), 0.0).otherwise(size)).alias("length"))
