"""Footprints and point clouds: which points lie in which ring, and what follows for elevations, layers and bounds.

Rings are vertex tables (id, pt_no, x, y), points have id, x, y and z. Points meet rings through bands of y, so nothing is
compared with everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.functions.numeric import side
from aerospan.operators.polygons import edges
from aerospan.operators.spatial import dealt_join, gathered, in_polygon, named, nearest


def in_box(values: list[Column], low: list[float], high: list[float]) -> Column:
    """Every value within its own bounds, ends included."""
    out = F.lit(True)
    for v, a, b in zip(values, low, high, strict=True):
        out = out & v.between(a, b)
    return out


def in_rings(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(id, poly): points inside rings."""
    return in_polygon(points.select("id", "x", "y"), edges(rings).select(F.col("id").alias("poly"), "x0", "y0", "x1", "y1"))


def ring_elevations(points: DataFrame, rings: DataFrame, share: float) -> DataFrame:
    """(poly, n, elevation, height, mean) of the points in each ring: elevation is the percentile ``share``, height the range."""
    z = points.select("id", "z").join(in_rings(points, rings), "id")
    return z.groupBy("poly").agg(F.count(F.lit(1)).alias("n"), F.percentile("z", share).alias("elevation"), (F.max("z") - F.min("z")).alias("height"), F.avg("z").alias("mean"))


def flattened(points: DataFrame, rings: DataFrame, share: float) -> DataFrame:
    """Points with ``z`` set to the elevation of the ring they lie in (of the least id, where rings overlap); others stay."""
    inside = in_rings(points, rings)
    level = inside.join(points.select("id", "z"), "id").groupBy("poly").agg(F.percentile("z", share).alias("_z"))
    own = inside.groupBy("id").agg(F.min("poly").alias("poly")).join(level, "poly").select("id", "_z")
    return points.join(own, "id", "left").withColumn("z", F.coalesce("_z", "z")).drop("_z")


def part_of(rings: DataFrame, others: DataFrame) -> DataFrame:
    """(id, poly): rings with all their vertices inside another ring, and no edge that crosses one of its edges."""
    key = F.struct("id", "pt_no")
    vertices = rings.select(key.alias("id"), "x", "y")
    n = rings.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    met = in_rings(vertices, others).groupBy(F.col("id.id").alias("id"), "poly").agg(F.count(F.lit(1)).alias("m"))
    # vertices and edges are many more than Spark guesses, so they are not left to be broadcast
    held = met.join(n.hint("merge"), "id").where("m = n and id <> poly").select("id", "poly")
    out = edges(others).select(F.col("id").alias("poly"), *(F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")))
    pair = held.join(edges(rings).hint("merge"), "id").join(out.hint("merge"), "poly")
    turn = lambda a, b, p: side(*(F.col(c) for c in (*a, *b, *p)))
    p, q, u, v = ("x0", "y0"), ("x1", "y1"), ("ox0", "oy0"), ("ox1", "oy1")
    crossed = pair.where((turn(p, q, u) * turn(p, q, v) < 0) & (turn(u, v, p) * turn(u, v, q) < 0)).select("id", "poly").distinct()
    return held.join(crossed.hint("merge"), ["id", "poly"], "left_anti")


def dimension2(rings: DataFrame) -> DataFrame:
    """(id, largest2): the square of the longer side of each ring's box."""
    longer = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return rings.groupBy("id").agg((longer * longer).alias("largest2"))


def influence(rings: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """(id, within): rings with a vertex within ``radius`` of the centre, and whether all of theirs are (the subset test)."""
    near = F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2) <= radius * radius
    return rings.groupBy("id").agg(F.bool_or(near).alias("some"), F.bool_and(near).alias("within")).where("some").select("id", "within")


def vertex_elevations(rings: DataFrame, cloud: DataFrame, k: int, radius: float) -> DataFrame:
    """Rings with z: the mean of the k nearest points of the cloud (id, x, y, z), weighted by inverse squared distance; a point at the
    vertex gives its own z."""
    q = rings.select(F.struct("id", "pt_no").alias("query"), "x", "y")
    found = nearest(cloud.select("id", "x", "y"), q, k, ["x", "y"], radius).join(cloud.select("id", "z"), "id")
    hit = F.max(F.when(F.col("d2") == 0, F.col("z")))
    far = F.when(F.col("d2") > 0, 1 / F.col("d2"))
    z = found.groupBy("query").agg(F.coalesce(hit, F.try_divide(F.sum(far * F.col("z")), F.sum(far))).alias("z"))
    return z.select("query.id", "query.pt_no", "z")


def layered(faces: DataFrame, rings: DataFrame, layer: Callable[[Column], Column]) -> DataFrame:
    """(id, layer): the layer of the ring (of the least id) that a face's centre (id, x, y) lies in; null outside."""
    found = in_rings(faces, rings).groupBy("id").agg(F.min("poly").alias("poly"))
    return faces.select("id").join(found, "id", "left").select("id", layer(F.col("poly")).alias("layer"))


def clipped(elements: DataFrame, nodes: DataFrame, inside: Column) -> DataFrame:
    """Elements (elem_id, nodes) all of whose nodes exist and satisfy ``inside`` over the nodes' columns."""
    kept = nodes.where(inside).select("node_id")
    n = elements.select("elem_id", F.explode("nodes").alias("node_id")).join(kept, "node_id").groupBy("elem_id").agg(F.count(F.lit(1)).alias("_n"))
    return elements.join(n, "elem_id").where(F.size("nodes") == F.col("_n")).drop("_n")


def cell_to_point(elements: DataFrame, value: str) -> DataFrame:
    """(node_id, value): mean over the elements at each node."""
    return elements.select(F.explode("nodes").alias("node_id"), value).groupBy("node_id").agg(F.avg(value).alias(value))


def padded(elements: DataFrame, fill: int = 0) -> DataFrame:
    """Elements with node lists of one length, that of the longest."""
    most = elements.agg(F.coalesce(F.max(F.size("nodes")), F.lit(0)).alias("_m"))  # one row
    pad = F.array_repeat(F.lit(fill).cast("long"), F.col("_m") - F.size("nodes"))
    return elements.crossJoin(F.broadcast(most)).withColumn("nodes", F.concat("nodes", pad)).drop("_m")


def box_search(points: DataFrame, queries: DataFrame, axes: list[str], half: float, fuzz: float = 0.0) -> DataFrame:
    """(query, id, sure) of points in the box of ``half`` the side around each query. With ``fuzz``, boxes are larger by that much, and
    ``sure`` says which points lie in the box smaller by that much."""
    size = half + fuzz
    cells = lambda x, s: F.floor(x / s).cast("long")
    p, q = gathered(points.select("id", *axes), "id"), gathered(queries.select("query", *(F.col(x).alias(f"q{x}") for x in axes)), "query")
    for x in axes:
        p = p.withColumn(f"_{x}", cells(F.col(x), 2 * size))
        q = q.withColumn(f"_{x}", F.explode(F.sequence(cells(F.col(f"q{x}") - size, 2 * size), cells(F.col(f"q{x}") + size, 2 * size))))
    j = dealt_join(p, q, [f"_{x}" for x in axes], members=("id", "query"))
    gap = F.greatest(*(F.abs(F.col(x) - F.col(f"q{x}")) for x in axes)) if len(axes) > 1 else F.abs(F.col(axes[0]) - F.col(f"q{axes[0]}"))
    return named(j.where(gap <= size).withColumn("sure", gap <= half - fuzz), "query", "id", "sure")
