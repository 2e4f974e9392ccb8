"""Faces of solid elements: which are shared and which bound the mesh, their outward area vectors, and what flows through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.functions import vectors as V
from aerospan.operators.mesh import gather

#: Corners of each face of tetrahedra, pyramids, wedges and hexahedra, outwards for elements numbered right-handed.
FACES = {
    30: [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)],
    32: [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
    34: [(0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)],
    37: [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)],
}


def faces(elements: DataFrame) -> DataFrame:
    """(elem_id, face, corners) of solid elements (elem_id, ltype, nodes); other types have none."""
    kinds = None
    for ltype, rows in FACES.items():
        made = F.array(*(F.array(*(F.get("nodes", F.lit(k)) for k in row)) for row in rows))
        kinds = (F.when if kinds is None else kinds.when)(F.col("ltype") == ltype, made)
    return elements.select("elem_id", F.posexplode(kinds).alias("face", "corners"))


def boundary_faces(elements: DataFrame) -> DataFrame:
    """(elem_id, face, corners) of the faces that one element alone has."""
    f = faces(elements)
    one = f.groupBy(F.array_sort("corners").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("elem_id", "face", "corners")).alias("r"))
    return one.where("n = 1").select("r.*")


def neighbours(elements: DataFrame) -> DataFrame:
    """(elem_id, face, other, other_face), both ways, of elements that share a face; where more than two do, each two of them."""
    f = faces(elements).select("elem_id", "face", F.array_sort("corners").alias("key"))
    sides = f.groupBy("key").agg(F.collect_list(F.struct("elem_id", "face")).alias("s")).where(F.size("s") > 1)
    pair = sides.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a <> b")
    return pair.select("a.elem_id", "a.face", F.col("b.elem_id").alias("other"), F.col("b.face").alias("other_face"))


def _means(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """The mean of each element's corners."""
    g = gather(elements, nodes.select("node_id", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    return g.groupBy("elem_id").agg(F.array(*(F.avg(c) for c in "xyz")).alias("_middle"))


def area_vectors(chosen: DataFrame, elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chosen`` faces (elem_id, face, corners) with ``normal``, of the face's area and away from its element, and ``centre``, the mean of its corners.

    A quadrilateral's is that of its bilinear surface: half the product of its diagonals. Which way is outwards is told by the element's
    middle, so left-handed elements come out right too. Faces with an unknown corner are left out.
    """
    known = nodes.select("node_id", F.array(*(F.col(c).cast("double") for c in "xyz")).alias("_p"))
    each = chosen.select("elem_id", "face", F.posexplode("corners").alias("pos", "node_id")).join(known, "node_id")
    made = each.groupBy("elem_id", "face").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_p"))), lambda s: s["_p"]).alias("_c"))
    out = chosen.join(made, ["elem_id", "face"]).where(F.size("_c") == F.size("corners")).join(_means(elements, nodes), "elem_id")
    c = lambda k: F.get("_c", F.lit(k))
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    four = F.size("_c") == 4
    out = out.withColumn("_u", F.when(four, minus(c(2), c(0))).otherwise(minus(c(1), c(0)))).withColumn("_v", F.when(four, minus(c(3), c(1))).otherwise(minus(c(2), c(0))))
    mean: Column = F.array(*(F.aggregate(F.transform("_c", _at(k)), F.lit(0.0), lambda s, x: s + x) / F.size("_c") for k in range(3)))
    out = out.withColumn("_n", V.cross(F.col("_u"), F.col("_v"))).withColumn("centre", mean)
    out = out.withColumn("_way", F.signum(V.dot(F.col("_n"), minus(F.col("centre"), F.col("_middle")))))
    return out.select("elem_id", "face", "corners", F.transform("_n", lambda x: x * F.col("_way") / 2).alias("normal"), "centre")


def _at(k: int):
    return lambda p: F.get(p, F.lit(k))


def node_normals(vectors: DataFrame) -> DataFrame:
    """(node_id, normal): unit normals at the corners of faces, from the sum of the area vectors there; null where these cancel."""
    parts = vectors.select(F.explode("corners").alias("node_id"), *(F.get("normal", F.lit(k)).alias(f"_{k}") for k in range(3)))
    s = parts.groupBy("node_id").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in range(3)))
    size = F.sqrt(sum((F.col(f"_{k}") * F.col(f"_{k}") for k in range(3)), F.lit(0.0)))
    return s.withColumn("_s", size).select("node_id", F.when(F.col("_s") > 0, F.array(*(F.col(f"_{k}") / F.col("_s") for k in range(3)))).alias("normal"))


def flux(vectors: DataFrame, field: DataFrame, values: list[str]) -> DataFrame:
    """One row, ``flux``: a vector field (node_id, three ``values``) through faces, by the mean over each face's corners (exact for linear fields on flat faces of three or parallel sides)."""
    each = vectors.select("elem_id", "face", "normal", F.explode("corners").alias("node_id")).join(field.select("node_id", *values), "node_id")
    mean = each.groupBy("elem_id", "face").agg(F.first("normal").alias("n"), *(F.avg(v).alias(v) for v in values))
    return mean.agg(F.sum(sum((F.get("n", F.lit(k)) * F.col(v) for k, v in enumerate(values)), F.lit(0.0))).alias("flux"))
