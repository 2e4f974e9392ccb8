"""City shapes and walls: rings moved outwards, caps, blockage of the flow, wall units, and moments of turbulent fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospan.operators.polygons import edges
from aerospan.operators.spatial import nearest


def offset(rings: DataFrame, by: float) -> DataFrame:
    """Rings (id, pt_no, x, y; counter-clockwise, no three neighbours on a line) with every edge moved outwards by ``by``: corners are where moved edges meet."""
    e = edges(rings)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.sqrt(dx * dx + dy * dy)
    e = e.select("id", "pt_no", "x0", "y0", (dx / size).alias("ux"), (dy / size).alias("uy"))
    w = Window.partitionBy("id").orderBy("pt_no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in ("ux", "uy"):
        e = e.withColumn(f"p{c}", F.coalesce(F.lag(c).over(w), F.last(c).over(whole)))
    nx, ny = F.col("uy") + F.col("puy"), -(F.col("ux") + F.col("pux"))
    scale = F.try_divide(F.lit(by), 1 + F.col("ux") * F.col("pux") + F.col("uy") * F.col("puy"))
    return e.select("id", "pt_no", (F.col("x0") + nx * scale).alias("x"), (F.col("y0") + ny * scale).alias("y"))


def caps(rings: DataFrame, height: float) -> DataFrame:
    """(id, tri_no, a, b, c, z): a fan of triangles over each convex ring, from its first vertex, at one height."""
    w = Window.partitionBy("id").orderBy("pt_no")
    v = rings.select("id", "pt_no", F.row_number().over(w).alias("k"), F.first("pt_no").over(w).alias("a"), F.lead("pt_no").over(w).alias("c"))
    return v.where("k > 1 and c is not null").select("id", (F.col("k") - 2).alias("tri_no"), "a", F.col("pt_no").alias("b"), "c", F.lit(height).alias("z"))


def blockage(rings: DataFrame, heights: DataFrame, degrees: float) -> DataFrame:
    """(id, width, area): what prisms over rings show to a flow along ``degrees``, a rectangle of their extent across it."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    across = F.col("y") * c - F.col("x") * s
    width = rings.groupBy("id").agg((F.max(across) - F.min(across)).alias("width"))
    return width.join(heights, "id").select("id", "width", (F.col("width") * F.col("height")).alias("area"))


def wall_units(nodes: DataFrame, walls: DataFrame, viscosity: float, axes: list[str], radius: float) -> DataFrame:
    """(node_id, distance, y_plus): distance to the nearest wall node (id, axes, slope of the speed there) in units of
    viscosity over friction velocity; the friction velocity is the root of viscosity times slope."""
    q = nodes.select(F.col("node_id").alias("query"), *axes)
    found = nearest(walls.select("id", *axes), q, 1, axes, radius).join(walls.select("id", "slope"), "id")
    distance = F.sqrt("d2")
    return found.select(F.col("query").alias("node_id"), distance.alias("distance"), (distance * F.sqrt(viscosity * F.abs("slope")) / viscosity).alias("y_plus"))


def central_moments(fields: DataFrame, keys: list[str], velocity: list[Column]) -> DataFrame:
    """Reynolds stresses r_ij and triple correlations t_ijk (i <= j <= k) of each group, from raw moments in one pass."""
    n = range(len(velocity))
    two, three = [(i, j) for i in n for j in n if i <= j], [(i, j, k) for i in n for j in n for k in n if i <= j <= k]
    name = lambda t, at: t + "".join(map(str, at))
    mean = lambda at: F.avg(math.prod((velocity[i] for i in at[1:]), start=velocity[at[0]])).alias(name("m", at))
    m = fields.groupBy(*keys).agg(*(mean((i,)) for i in n), *map(mean, two), *map(mean, three))
    c = lambda *at: F.col(name("m", sorted(at)))
    stress = [(c(i, j) - c(i) * c(j)).alias(name("r", (i, j))) for i, j in two]
    triple = [(c(i, j, k) - c(i) * c(j, k) - c(j) * c(i, k) - c(k) * c(i, j) + 2 * c(i) * c(j) * c(k)).alias(name("t", (i, j, k))) for i, j, k in three]
    return m.select(*keys, *stress, *triple)


def contains(low: Column, high: Column, low_closed: Column, high_closed: Column, value: Column) -> Column:
    """Whether an interval with open or closed ends holds a value; equal ends hold it if either is closed."""
    return ((value > low) & (value < high)) | ((value == low) & low_closed) | ((value == high) & high_closed)


def contains_interval(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether an interval holds another; open or closed ends do not matter."""
    return (low <= other_low) & (high >= other_high)
