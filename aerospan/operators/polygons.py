"""Polygons as vertex tables (id, pt_no, x, y), rotations, slices, interpolation, sampling and derived scales."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospan.functions import vectors as V


def edges(rings: DataFrame) -> DataFrame:
    """Each vertex with the next one of its ring, closed: (id, pt_no, x0, y0, x1, y1)."""
    w = Window.partitionBy("id").orderBy("pt_no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return rings.select("id", "pt_no", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1"))


def area(rings: DataFrame) -> DataFrame:
    """Signed area by the shoelace formula, and length of the outline."""
    e = edges(rings)
    return e.groupBy("id").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"), F.sum(F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))).alias("outline"))


def shortened(rings: DataFrame, longest: float) -> DataFrame:
    """Edges longer than ``longest`` are cut into equal parts: (id, pt_no, part, x, y)."""
    e = edges(rings)
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) / longest).cast("int"))
    parts = e.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("part") / F.col("n")
    return parts.select("id", "pt_no", "part", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def transformed(rings: DataFrame, a: float, b: float, c: float, d: float, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """x' = a x + b y + dx, y' = c x + d y + dy."""
    return rings.withColumns({"x": a * F.col("x") + b * F.col("y") + dx, "y": c * F.col("x") + d * F.col("y") + dy})


def turned(x: Column, y: Column, degrees: float, cx: float = 0.0, cy: float = 0.0) -> tuple[Column, Column]:
    """Rotate about a centre in the plane, counter-clockwise."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return cx + c * (x - cx) - s * (y - cy), cy + s * (x - cx) + c * (y - cy)


def about_axis(p: Column, axis: tuple[float, float, float], degrees: float) -> Column:
    """Rodrigues' rotation of a vector about a unit axis through the origin."""
    k = V.literal(list(axis))
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    along = V.dot(k, p) * (1 - c)
    x = V.cross(k, p)
    return F.array(*(V.comp(p, i) * c + V.comp(x, i) * s + V.comp(k, i) * along for i in range(3)))


def smallest_boxes(hull_rings: DataFrame) -> DataFrame:
    """Least-area bounding rectangle of convex rings: one side lies along an edge. (id, angle, area)."""
    e = edges(hull_rings).select("id", F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("angle")).distinct()
    j = e.join(hull_rings.select("id", "x", "y"), "id")
    u, v = F.col("x") * F.cos("angle") + F.col("y") * F.sin("angle"), F.col("y") * F.cos("angle") - F.col("x") * F.sin("angle")
    a = j.groupBy("id", "angle").agg(((F.max(u) - F.min(u)) * (F.max(v) - F.min(v))).alias("area"))
    return a.groupBy("id").agg(F.min(F.struct(F.round("area", 9).alias("a"), "angle")).alias("r")).select("id", F.col("r.angle").alias("angle"), F.col("r.a").alias("area"))


def in_contact(rings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, other) of the given pairs of rings with edges that cross or touch, or of which one holds the other's vertices.

    Edges are several times as many as Spark guesses (it does not count what is exploded), so none of the joins may be a broadcast.
    """
    e = edges(rings)
    b = e.select(F.col("id").alias("other"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    j = pairs.join(e.hint("merge"), "id").join(b.hint("merge"), "other")
    turn = lambda ax, ay, bx, by, px, py: F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))
    p, q = ("x0", "y0", "x1", "y1"), ("bx0", "by0", "bx1", "by1")
    cross = (turn(*p, *q[:2]) * turn(*p, *q[2:]) <= 0) & (turn(*q, *p[:2]) * turn(*q, *p[2:]) <= 0)
    over = (F.greatest("x0", "x1") >= F.least("bx0", "bx1")) & (F.greatest("bx0", "bx1") >= F.least("x0", "x1")) & (F.greatest("y0", "y1") >= F.least("by0", "by1")) & (F.greatest("by0", "by1") >= F.least("y0", "y1"))
    touching = j.where(cross & over).select("id", "other").distinct()
    first = rings.groupBy("id").agg(F.min_by(F.struct("x", "y"), "pt_no").alias("p")).select("id", "p.x", "p.y")
    # crossing numbers of the given pairs alone: in all rings a vertex would meet nearly every ring
    named = pairs.select("id", "other").distinct()
    both = named.select("id", "other", F.col("id").alias("point"), F.col("other").alias("poly")).unionByName(named.select("id", "other", F.col("other").alias("point"), F.col("id").alias("poly")))
    far = both.join(first.withColumnRenamed("id", "point").hint("merge"), "point").join(e.withColumnRenamed("id", "poly").hint("merge"), "poly")
    spans = (F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))
    cut = F.col("x0") + (F.col("y") - F.col("y0")) * F.try_divide(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    inside = far.where(spans & (F.col("x") < cut)).groupBy("id", "other", "poly").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("id", "other")
    return touching.unionByName(inside).distinct()


def round_rings(centres: DataFrame, points: int, radius: Column, second: Column | None = None, step: float | None = None, start: float = 0.0) -> DataFrame:
    """Points (id, pt_no, x, y) around centres (id, x, y), counter-clockwise from angle ``start``, ``step`` radians apart (by default a whole
    round); with a second radius along y they lie on ellipses. Radii are columns of ``centres``."""
    turn = start + F.col("pt_no") * (2 * math.pi / points if step is None else step)
    c = centres.withColumn("_a", radius).withColumn("_b", radius if second is None else second)
    c = c.select("id", "x", "y", "_a", "_b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("pt_no"))
    return c.select("id", "pt_no", (F.col("x") + F.col("_a") * F.cos(turn)).alias("x"), (F.col("y") + F.col("_b") * F.sin(turn)).alias("y"))


def plane_slice(edge_values: DataFrame, level: float) -> DataFrame:
    """Where edges (edge_id, a, b: struct<x, y, z, v>) cross a value of v: the point between, by linear interpolation."""
    va, vb = F.col("a.v"), F.col("b.v")
    t = F.try_divide(level - va, vb - va)
    cross = edge_values.where(((va <= level) & (vb > level)) | ((vb <= level) & (va > level)))
    return cross.select("edge_id", *((F.col(f"a.{c}") + t * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in ("x", "y", "z")))


def interpolated(points: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """(id, tri_id, v): value at points (id, x, y) in triangles (tri_id, p, f: values at corners), lowest number first.

    Candidates meet in grid cells; barycentric coordinates decide. A point outside all triangles has no row.
    """
    c = lambda k, j: F.get(F.get("p", F.lit(k)), F.lit(j))
    t, pts = triangles, points
    for j, x in enumerate("xy"):
        low, high = F.least(c(0, j), c(1, j), c(2, j)), F.greatest(c(0, j), c(1, j), c(2, j))
        t = t.withColumn(f"_{x}", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
        pts = pts.withColumn(f"_{x}", F.floor(F.col(x) / size))
    ux, uy, vx, vy = c(1, 0) - c(0, 0), c(1, 1) - c(0, 1), c(2, 0) - c(0, 0), c(2, 1) - c(0, 1)
    px, py, d = F.col("x") - c(0, 0), F.col("y") - c(0, 1), ux * vy - uy * vx
    a, b = F.try_divide(px * vy - py * vx, d), F.try_divide(ux * py - uy * px, d)
    j = pts.join(t, ["_x", "_y"]).withColumn("_a", a).withColumn("_b", b).where("_a >= -1e-12 and _b >= -1e-12 and _a + _b <= 1 + 1e-12")
    f = lambda k: F.get("f", F.lit(k))
    v = f(0) * (1 - F.col("_a") - F.col("_b")) + f(1) * F.col("_a") + f(2) * F.col("_b")
    return j.groupBy("id").agg(F.min(F.struct("tri_id", v.alias("v"))).alias("r")).select("id", "r.tri_id", "r.v")


def matched(a: DataFrame, b: DataFrame, axes: list[str], tol: float) -> DataFrame:
    """(id, other) of points closer than ``tol``: cells of that size, each point looked for in its cell's neighbours."""
    near = b.select(F.col("id").alias("other"), *(F.col(x).alias(f"b{x}") for x in axes))
    for x in axes:
        a = a.withColumn(f"_{x}", F.floor(F.col(x) / tol))
        k = F.floor(F.col(f"b{x}") / tol)
        near = near.withColumn(f"_{x}", F.explode(F.array(k - 1, k, k + 1)))
    d2 = sum((F.pow(F.col(x) - F.col(f"b{x}"), 2) for x in axes), F.lit(0.0))
    return a.join(near, [f"_{x}" for x in axes]).where(d2 < tol * tol).select("id", "other")


def thinned(df: DataFrame, percent: float, key: str, seed: int = 0) -> DataFrame:
    """Exactly floor(n p / 100) rows are removed, chosen by a hash of the key.

    The hashes' range is cut into 2^16 parts and counted; rows below the part that holds the threshold stay where they are, and
    only that part's rows are put in order.
    """
    hashed = df.withColumn("_h", F.xxhash64(key, F.lit(seed)))
    part = F.shiftright("_h", 48)
    counts = sorted((r["part"], r["count"]) for r in hashed.groupBy(part.alias("part")).count().collect())  # at most 2^16 rows
    n = sum(c for _, c in counts)
    keep = n - math.floor(n * percent / 100)
    for at, count in counts:
        if keep <= count:
            break
        keep -= count
    else:
        return df.where("false")
    below = hashed.where(part < at).drop("_h")
    return below.unionByName(hashed.where(part == at).orderBy("_h", key).limit(keep).drop("_h"))


def combinations(items: DataFrame, value: str) -> DataFrame:
    """Pairs a < b of a list of values; meant for short lists (it is their square)."""
    a, b = items.select(F.col(value).alias("a")), items.select(F.col(value).alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def small_scales(tke: Column, dissipation: Column, nu: float) -> tuple[Column, Column, Column]:
    """Taylor's microscale, Kolmogorov's length and time."""
    return F.sqrt(F.try_divide(10 * nu * tke, dissipation)), F.pow(F.try_divide(F.lit(nu**3), dissipation), 0.25), F.sqrt(F.try_divide(F.lit(nu), dissipation))


def tiled(points: DataFrame, origin: tuple[float, float], step: float, n: int, spacing: float, across: int) -> DataFrame:
    """Points in every overlapping tile that holds them: tile numbers along x first; i from the top, j from the left."""
    span = n * spacing
    reach = int(math.ceil(span / step))
    kx, ky = F.floor((F.col("x") - origin[0]) / step), F.floor((F.col("y") - origin[1]) / step)
    out = points.withColumn("_i", F.explode(F.sequence(F.greatest(F.lit(0), kx - reach + 1), F.greatest(F.lit(0), kx)))).withColumn("_j", F.explode(F.sequence(F.greatest(F.lit(0), ky - reach + 1), F.greatest(F.lit(0), ky))))
    lx, ly = F.col("x") - origin[0] - F.col("_i") * step, F.col("y") - origin[1] - F.col("_j") * step
    inside = out.where((lx >= 0) & (lx < span) & (ly >= 0) & (ly < span) & (F.col("_i") < across))
    return inside.select("id", (F.col("_j") * across + F.col("_i")).alias("tile"), (n - 1 - F.floor(ly / spacing)).alias("i"), F.floor(lx / spacing).alias("j"))
