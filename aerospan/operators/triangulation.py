"""Triangles over polygons that need not be convex and may have holes, without new points; and solids raised over them.

Every vertex looks straight down at the first edge below it. The vertices that see an edge cut what lies above it into trapezoids; the
left and the right vertex of each are joined by a diagonal where they aren't joined already. What is left are pieces between one edge and
a chain above or below it. In such a piece a vertex makes a triangle with the nearest ones on both sides that are closer to the edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerospan.operators.arrangement import _arriving, _below, _incident, _next_at, crowded, cycles
from aerospan.session import stored


def _sides(rings: DataFrame, scale: float) -> DataFrame:
    """Directed edges (id, e, ox, oy, tx, ty) of rings (id, polygon, ring, pt_no, x, y), in whole units."""
    at = rings.select("id", "polygon", "ring", "pt_no", F.round(F.col("x") * scale).cast("long").alias("ox"), F.round(F.col("y") * scale).cast("long").alias("oy"))
    w = Window.partitionBy("id", "polygon", "ring").orderBy("pt_no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(n) for c, n in (("ox", "tx"), ("oy", "ty"))]
    return stored(at.select("id", "ox", "oy", *nxt).withColumn("e", F.monotonically_increasing_id()))


def diagonals(sides: DataFrame) -> DataFrame:
    """(id, ax, ay, bx, by): from the left to the right vertex of each trapezoid in which they aren't neighbours."""
    right = (F.col("tx") > F.col("ox")) | ((F.col("tx") == F.col("ox")) & (F.col("ty") > F.col("oy")))
    ends = [F.when(right, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("ax", "ox", "tx"), ("ay", "oy", "ty"), ("bx", "tx", "ox"), ("by", "ty", "oy"))]
    edges = sides.select("id", "e", *ends, right.alias("floor"))
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    seen = _below(sides.select("id", F.col("ox").alias("x"), F.col("oy").alias("y")).distinct(), edges)
    seen = seen.groupBy("id", "x", "y").agg(F.max_by(F.struct("e", "floor"), F.struct("_h", slope.alias("slope"))).alias("r")).where("r.floor").select("id", "r.e", "x", "y")
    floors = edges.where("floor")
    marks = seen.unionByName(floors.select("id", "e", F.col("ax").alias("x"), F.col("ay").alias("y"))).unionByName(floors.select("id", "e", F.col("bx").alias("x"), F.col("by").alias("y")))
    w = Window.partitionBy("e").orderBy("x", "y")
    pairs = marks.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    return pairs.join(edges.select("id", "ax", "ay", "bx", "by"), ["id", "ax", "ay", "bx", "by"], "left_anti")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Triangles of pieces whose vertices come one after the other, in order round each piece."""
    held: list[tuple] = []

    def cut(ring: list[tuple]) -> list[tuple]:
        if len(ring) < 3:
            return []
        pts = [r[2:] for r in ring]
        low, high = min(range(len(pts)), key=pts.__getitem__), max(range(len(pts)), key=pts.__getitem__)
        pts = pts[low:] + pts[:low]
        high = (high - low) % len(pts)
        chain = [*pts[high:], pts[0]] if high == 1 else pts  # the base joins the two ends of the chain
        (x0, y0), (x1, y1) = chain[0], chain[-1]
        far = [abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) for x, y in chain]
        far[0] = far[-1] = -1
        left, stack, out = [0] * len(chain), [0], []
        for k in range(1, len(chain)):
            while far[stack[-1]] > far[k]:
                top = stack.pop()
                out.append((left[top], top, k))
            if k < len(chain) - 1 or far[stack[-1]] > -1:
                left[k] = stack[-1]
            stack.append(k)
        tri = []
        for a, b, c in out:
            (ax, ay), (bx, by), (cx, cy) = chain[a], chain[b], chain[c]
            turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
            if turn:
                tri.append((ring[0][0], *((ax, ay, bx, by, cx, cy) if turn > 0 else (ax, ay, cx, cy, bx, by))))
        return tri

    names = ["id", "ax", "ay", "bx", "by", "cx", "cy"]
    for pdf in batches:
        rows, at = list(zip(pdf["id"], pdf["cycle"].tolist(), pdf["ox"].tolist(), pdf["oy"].tolist(), strict=True)), 0
        done: list[tuple] = []
        for row in rows:
            if held and held[0][1] != row[1]:
                done += cut(held)
                held = []
            held.append(row)
            at += 1
        if done:
            yield pd.DataFrame(done, columns=names)
    if held and (done := cut(held)):
        yield pd.DataFrame(done, columns=names)


def triangulated(rings: DataFrame, digits: int = 9) -> DataFrame:
    """(id, tri_no, ax, ay, bx, by, cx, cy): counter-clockwise triangles that fill valid polygons.

    ``rings`` are what ``arrangement.repaired`` gives: outer rings counter-clockwise, holes clockwise. Corners are the rings' vertices; n vertices
    and h holes give n + 2 h - 2 triangles for each polygon (two less for each vertex at which rings meet). A task holds one piece between an edge and its chain at a time.
    """
    scale = 10.0**digits
    sides = _sides(rings, scale)
    extra = stored(diagonals(sides).withColumn("e", F.monotonically_increasing_id()))
    ways = [extra.select("id", F.struct(F.lit(k).alias("kind"), "e").alias("h"), *(F.col(p).alias(q) for p, q in zip(ends, ("ox", "oy", "tx", "ty"), strict=True))) for k, ends in ((1, ("ax", "ay", "bx", "by")), (2, ("bx", "by", "ax", "ay")))]
    half = sides.select("id", F.struct(F.lit(0).alias("kind"), "e").alias("h"), "ox", "oy", "tx", "ty").unionByName(ways[0]).unionByName(ways[1])
    half = half.withColumn("h", F.col("h.e") * 4 + F.col("h.kind"))
    many = crowded(half)
    links = _arriving(_next_at(_incident(half, many), many, ["vx", "vy"], F.desc("angle"), F.desc("out")))
    pieces = cycles(links).select("id", "cycle", "pos", "ox", "oy")
    kind = rings.schema["id"].dataType.simpleString()
    found = pieces.repartition("cycle").sortWithinPartitions("cycle", "pos").drop("pos").mapInPandas(_pieces, f"id {kind}, ax long, ay long, bx long, by long, cx long, cy long")
    corners = ("ax", "ay", "bx", "by", "cx", "cy")
    number = F.row_number().over(Window.partitionBy("id").orderBy(*corners)) - 1
    return found.select("id", number.alias("tri_no"), *((F.col(c) / scale).alias(c) for c in corners))


def raised(rings: DataFrame, heights: DataFrame, digits: int = 9) -> DataFrame:
    """(id, part, p): closed surfaces of prisms from ``heights`` (id, base, top) over valid polygons: floor, roof and walls.

    ``p`` holds three corners, each [x, y, z], and the triangle faces outwards.
    """
    t = triangulated(rings, digits).join(heights, "id")
    at = lambda x, y, z: F.array(F.col(x), F.col(y), F.col(z))
    roof = t.select("id", F.lit("roof").alias("part"), F.array(at("ax", "ay", "top"), at("bx", "by", "top"), at("cx", "cy", "top")).alias("p"))
    floor = t.select("id", F.lit("floor").alias("part"), F.array(at("ax", "ay", "base"), at("cx", "cy", "base"), at("bx", "by", "base")).alias("p"))
    scale = 10.0**digits
    s = _sides(rings, scale).select("id", *((F.col(c) / scale).alias(c) for c in ("ox", "oy", "tx", "ty"))).join(heights, "id")
    one = F.array(at("ox", "oy", "base"), at("tx", "ty", "base"), at("tx", "ty", "top"))
    two = F.array(at("ox", "oy", "base"), at("tx", "ty", "top"), at("ox", "oy", "top"))
    walls = s.select("id", F.lit("wall").alias("part"), F.explode(F.array(one, two)).alias("p"))
    return roof.unionByName(floor).unionByName(walls)
