"""Polygon repair, booleans, triangulated caps and solids over rings made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerospan.operators import arrangement as A
from aerospan.operators import triangulation as T
from aerospan.registry import query, rounded, table


def shapes(spark: SparkSession, sf_dir: str, kinds: str) -> DataFrame:
    """(id, ring, pt_no, x, y): for each part the rings that an SQL expression lists as [[[x, y], ...], ...], in units of its size s."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("s"))
    r = p.select("id", F.posexplode(F.expr(kinds)).alias("ring", "_r")).select("id", "ring", F.posexplode("_r").alias("pt_no", "_p"))
    return r.select("id", "ring", "pt_no", F.get("_p", F.lit(0)).alias("x"), F.get("_p", F.lit(1)).alias("y"))


def square(x: str, y: str, w: str, h: str) -> str:
    return f"array(array({x}, {y}), array({x} + {w}, {y}), array({x} + {w}, {y} + {h}), array({x}, {y} + {h}))"


ZERO = "cast(0 as double)"
INNER = square("s / 4", "s / 4", "s / 2", "s / 2")
WHOLE = square(ZERO, ZERO, "s", "s")
CROSSED = f"array(array({ZERO}, {ZERO}), array(s, s), array(s, {ZERO}), array({ZERO}, s))"


def summary(rings: DataFrame) -> DataFrame:
    """(id, polygon, ring, area) of result rings."""
    keyed = rings.select(F.struct("id", "polygon", "ring").alias("id"), F.lit(0).alias("ring"), "pt_no", "x", "y")
    s = A.segments(keyed)
    return s.groupBy("id").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area")).select("id.*", "area")


def totals(rings: DataFrame) -> DataFrame:
    s = summary(rings)
    hole = F.col("area") < 0
    return s.groupBy("id").agg(F.count(F.when(~hole, 1)).alias("polygons"), F.count(F.when(hole, 1)).alias("holes"), rounded(F.sum("area")).alias("area"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 IN (0, 3) THEN 2 ELSE 1 END AS polygons, CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END AS holes,
round(p_size * p_size * CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 ELSE 1.5 END, 6)::DOUBLE AS area FROM part""")
def polygon_repair(spark, sf_dir):
    """Outlines that cross themselves, holes that are filled again, holes, and overlapping squares, by the even-odd rule."""
    shifted = square("s / 2", "s / 2", "s", "s")
    kinds = f"case id % 4 when 0 then array({CROSSED}) when 1 then array({WHOLE}, {INNER}, {INNER}) when 2 then array({WHOLE}, {INNER}) else array({WHOLE}, {shifted}) end"
    return totals(A.repaired(shapes(spark, sf_dir, kinds)))


#: Two boxes a part: one from its size, one from its number. In SQL with the size of what they share.
SECOND = ("cast(id % 13 as double)", "cast(id % 17 as double)", "1 + id % 23", "1 + id % 19")
BOXES = """b AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 13 AS u, p_partkey % 17 AS v, 1 + p_partkey % 23 AS w, 1 + p_partkey % 19 AS h FROM part),
o AS (SELECT *, greatest(0, least(s, u + w) - u) * greatest(0, least(2 * s, v + h) - v) AS common, u > 0 AND v > 0 AND u + w < s AND v + h < 2 * s AS within FROM b)"""


def boxes(spark, sf_dir):
    return shapes(spark, sf_dir, f"array({square(ZERO, ZERO, 's', '2 * s')})"), shapes(spark, sf_dir, f"array({square(*SECOND)})")


@query(f"WITH {BOXES} SELECT id, round(2 * s * s + w * h - common, 6)::DOUBLE AS area, 0 AS holes FROM o")
def polygon_join(spark, sf_dir):
    return totals(A.overlaid(*boxes(spark, sf_dir), "join")).select("id", "area", "holes")


@query(f"WITH {BOXES} SELECT id, common::DOUBLE AS area, 1 AS polygons FROM o WHERE common > 0")
def polygon_intersection(spark, sf_dir):
    return totals(A.overlaid(*boxes(spark, sf_dir), "intersection")).select("id", "area", "polygons")


@query(f"WITH {BOXES} SELECT id, (2 * s * s - common)::DOUBLE AS area, within::INT AS holes FROM o WHERE 2 * s * s > common")
def polygon_difference(spark, sf_dir):
    return totals(A.overlaid(*boxes(spark, sf_dir), "difference")).select("id", "area", "holes")


@query(f"WITH {BOXES} SELECT id, (2 * s * s + w * h - 2 * common)::DOUBLE AS area FROM o WHERE 2 * s * s + w * h > 2 * common")
def polygon_symmetric_difference(spark, sf_dir):
    return totals(A.overlaid(*boxes(spark, sf_dir), "symmetric")).select("id", "area")


@query("SELECT p_partkey AS id, k AS polygon, (CASE WHEN k < 0 THEN -1.0 ELSE 0.25 END * p_size * p_size)::DOUBLE AS area FROM part, (VALUES (-1), (0)) t(k)")
def polygon_complement(spark, sf_dir):
    """Outside of squares with a hole: the plane without the square, and the hole."""
    return summary(A.complement(shapes(spark, sf_dir, f"array({WHOLE}, {INNER})"))).select("id", "polygon", "area")


#: A building with a bay between two wings, and a court in its base.
COURT = square("s / 4", "s / 4", "s / 2", "s / 2")
WINGS = f"array(array({ZERO}, {ZERO}), array(4 * s, {ZERO}), array(4 * s, 3 * s), array(3 * s, 3 * s), array(3 * s, s), array(s, s), array(s, 3 * s), array({ZERO}, 3 * s))"


def buildings(spark, sf_dir):
    return A.repaired(shapes(spark, sf_dir, f"array({WINGS}, {COURT})"))


@query("SELECT p_partkey AS id, 12 AS triangles, (7.75 * p_size * p_size)::DOUBLE AS area, 0::DOUBLE AS outside FROM part")
def cap_triangles(spark, sf_dir):
    """Roofs that are not convex and have a hole; ``outside`` is the area of triangles whose middle lies in the bay or the court."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"))
    t = T.triangulated(buildings(spark, sf_dir)).join(s, "id")
    a = ((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2
    mx, my = (sum((F.col(p + c) for p in "abc"), F.lit(0.0)) / 3 / F.col("s") for c in "xy")
    out = (mx.between(1.000001, 2.999999) & (my > 1.000001)) | (mx.between(0.250001, 0.749999) & my.between(0.250001, 0.749999))
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"), rounded(F.sum(a)).alias("area"), rounded(F.sum(F.when(out, a).otherwise(0.0))).alias("outside"))


@query("""SELECT p_partkey AS id, 2 * 12 + 2 * 12 AS triangles, (7.75 * p_size * p_size * (1 + p_partkey % 9))::DOUBLE AS volume, 0::DOUBLE AS leak,
round(2 * 7.75 * p_size * p_size + (4 + 3 + 1 + 2 + 2 + 2 + 1 + 3 + 2) * p_size * (1 + p_partkey % 9), 6)::DOUBLE AS surface FROM part""")
def building_solids(spark, sf_dir):
    """Closed solids over such roofs: volume by the divergence theorem, surface, and the sum of the normals."""
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("base"), (1.0 + F.col("p_partkey") % 9).alias("top"))
    f = T.raised(buildings(spark, sf_dir), h)
    c = lambda k, j: F.get(F.get("p", F.lit(k)), F.lit(j))
    u, v = [[c(k, j) - c(0, j) for j in range(3)] for k in (1, 2)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(sum((x * x for x in n), F.lit(0.0))) / 2
    leak = F.abs(F.sum(n[0])) + F.abs(F.sum(n[1])) + F.abs(F.sum(n[2]))
    flux = sum((c(0, j) * n[j] for j in range(3)), F.lit(0.0)) / 6
    return f.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"), rounded(F.sum(flux)).alias("volume"), (rounded(leak) + 0.0).alias("leak"), rounded(F.sum(size)).alias("surface"))
