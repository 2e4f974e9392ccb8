"""Meshes and finite elements as tables: nodes (node_id, x, y, z), elements (elem_id, ltype, nodes).

Element loops become joins: gather is an explode and an equi-join on the node, scatter is a grouped sum. Nodes are
unique, so there is no halo exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerospan.functions import vectors as V
from aerospan.functions.numeric import bunching, triangle_area
from aerospan.functions.shapes import jacobians, rule
from aerospan.session import cut_lineage

#: Element type codes, with their name and number of nodes.
TYPES = {2: ("bar", 2), 10: ("triangle", 3), 12: ("quadrilateral", 4), 30: ("tetrahedron", 4), 32: ("pyramid", 5), 34: ("wedge", 6), 37: ("hexahedron", 8), 39: ("hexahedron27", 27), 40: ("hexahedron64", 64)}


def _axis(k: Column, n: int, length: float, crowded: bool, strength: float) -> Column:
    c = k / (n - 1) * length if n > 1 else F.lit(0.0)
    return bunching(c, length, strength) if crowded else c


def plane_nodes(spark: SparkSession, lengths: tuple[float, float], n1: int, n2: int, conc: int = 0, f: float = 0.2) -> DataFrame:
    """An axis-aligned plane from the origin, first axis fastest. ``conc`` 1 and 2 crowd that axis, 3 both, 0 none."""
    if not 0 <= conc <= 3:
        raise ValueError(f"invalid concentration {conc}")
    i, j = F.col("id") % n1, F.floor(F.col("id") / n1)
    x, y = _axis(i, n1, lengths[0], conc in (1, 3), f), _axis(j, n2, lengths[1], conc in (2, 3), f)
    return spark.range(n1 * n2).select(F.col("id").alias("node_id"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))


def plane_elements(spark: SparkSession, n1: int, n2: int) -> DataFrame:
    """Quadrilaterals (i,j), (i,j+1), (i+1,j+1), (i+1,j) of the plane's nodes, first index outermost."""
    i, j = F.floor(F.col("id") / (n2 - 1)), F.col("id") % (n2 - 1)
    at = lambda a, b: (i + a) + (j + b) * n1
    nodes = F.array(*(at(a, b).cast("long") for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))))
    return spark.range((n1 - 1) * (n2 - 1)).select(F.col("id").alias("elem_id"), F.lit(12).alias("ltype"), nodes.alias("nodes"))


def cube_nodes(spark: SparkSession, lengths: tuple[float, float, float], n1: int, n2: int, n3: int, conc: int = 0, f: float = 0.2) -> DataFrame:
    """An axis-aligned box from the origin, first axis fastest. ``conc`` 1 to 3 crowd that axis; 4 all but the first."""
    if not 0 <= conc <= 4:
        raise ValueError(f"invalid concentration {conc}")
    i, j, k = F.col("id") % n1, F.floor(F.col("id") / n1) % n2, F.floor(F.col("id") / (n1 * n2))
    x, y, z = _axis(i, n1, lengths[0], conc in (1, 3), f), _axis(j, n2, lengths[1], conc in (2, 4), f), _axis(k, n3, lengths[2], conc in (3, 4), f)
    return spark.range(n1 * n2 * n3).select(F.col("id").alias("node_id"), x.alias("x"), y.alias("y"), z.alias("z"))


def cube_elements(spark: SparkSession, n1: int, n2: int, n3: int) -> DataFrame:
    """Hexahedra: the quadrilateral of each layer in (j, k) order, then the one a step further along the first axis."""
    i, j, k = F.floor(F.col("id") / ((n2 - 1) * (n3 - 1))), F.floor(F.col("id") / (n3 - 1)) % (n2 - 1), F.col("id") % (n3 - 1)
    at = lambda a, b, c: ((i + a) + (j + b) * n1 + (k + c) * n1 * n2).cast("long")
    ring = ((0, 0), (0, 1), (1, 1), (1, 0))
    nodes = F.array(*(at(a, b, c) for a in (0, 1) for b, c in ring))
    return spark.range((n1 - 1) * (n2 - 1) * (n3 - 1)).select(F.col("id").alias("elem_id"), F.lit(37).alias("ltype"), nodes.alias("nodes"))


def decimate(nodes: DataFrame, n1: int, n2: int, step: int) -> DataFrame:
    """Every ``step``-th node of a structured plane along both axes, renumbered."""
    i, j = F.col("node_id") % n1, F.floor(F.col("node_id") / n1)
    width = -(-n1 // step)
    kept = nodes.where((i % step == 0) & (j % step == 0))
    return kept.withColumn("node_id", (F.floor(i / step) + F.floor(j / step) * width).cast("long"))


def corners(elements: DataFrame) -> DataFrame:
    """A row for each corner: elem_id, pos, node_id; padding of -1 is left out."""
    return elements.select("elem_id", F.posexplode("nodes").alias("pos", "node_id")).where("node_id >= 0")


def gather(elements: DataFrame, field: DataFrame) -> DataFrame:
    """Corners with the columns of ``field`` (node_id, ...)."""
    return corners(elements).join(field, "node_id")


def scatter(corner_values: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of the corner values at each node."""
    return corner_values.groupBy("node_id").agg(F.sum(value).alias(out))


def centers(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    return gather(elements, nodes).groupBy("elem_id").agg(*(F.avg(c).alias(c) for c in ("x", "y", "z")))


def neighbours(elements: DataFrame) -> DataFrame:
    """Pairs of different nodes that share an element."""
    a = corners(elements)
    b = a.select("elem_id", F.col("node_id").alias("other"))
    return a.join(b, "elem_id").where("node_id <> other").select("node_id", "other").distinct()


def shaped(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each element: its nodes and the list ``p`` of its corners' coordinates, in order."""
    point = F.struct("pos", F.array("x", "y", "z").alias("p"))
    made = gather(elements, nodes).groupBy("elem_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda s: s["p"]).alias("p"))
    return elements.join(made, "elem_id")


def at(p: Column, k: int) -> list[Column]:
    return [F.get(F.get(p, F.lit(k)), F.lit(c)) for c in range(3)]


def measure(p: Column, ltype: int) -> Column:
    """Length, area or volume of an element with straight edges (plane quadrilaterals, parallelepipeds for hexahedra)."""
    if ltype == 10:
        return triangle_area(at(p, 0), at(p, 1), at(p, 2))
    if ltype == 12:
        return triangle_area(at(p, 0), at(p, 1), at(p, 2)) + triangle_area(at(p, 2), at(p, 3), at(p, 0))
    if ltype in (30, 37):
        o, edges = at(p, 0), (1, 2, 3) if ltype == 30 else (1, 3, 4)
        a, b, c = ([x - y for x, y in zip(at(p, k), o, strict=True)] for k in edges)
        volume = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
        return F.abs(volume) / (6 if ltype == 30 else 1)
    if ltype == 2:
        return F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(at(p, 0), at(p, 1), strict=True)), F.lit(0.0)))
    raise ValueError(f"no measure for element type {ltype}")


def measured(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elements with ``w``, their measure; a CASE over the types that have one."""
    s, w = shaped(elements, nodes), None
    for t in (2, 10, 12, 30, 37):
        w = (F.when if w is None else w.when)(F.col("ltype") == t, measure(F.col("p"), t))
    return s.withColumn("w", w)


def _parts(batch: pa.RecordBatch, types: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch by element type, in pieces of which the arrays at all Gauss points and of all pairs of corners stay small."""
    for t in np.unique(types):
        part = batch.filter(pa.array(types == t))
        points, corners = rule(int(t))[1].shape
        step = max(1, 4_000_000 // max(corners * corners, 9 * points))
        yield from (part.slice(k, step) for k in range(0, part.num_rows, step))


def summed(elements: DataFrame, nodes: DataFrame, what: Callable, columns: str, field: DataFrame | None = None) -> DataFrame:
    """Rows (elem_id, nodes, then ``columns``) of sums over Gauss points: ``what`` gets an element type, its corners (e, corners, 3)
    and, if there is a ``field`` (node_id, f), its corner values (e, corners), and gives an array for each column."""
    known = nodes.select("node_id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    known = known if field is None else known.join(field, "node_id")
    corner = F.struct("pos", F.array("x", "y", "z", *([] if field is None else ["f"])).alias("p"))
    made = gather(elements, known).groupBy("elem_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(corner)), lambda s: s["p"])).alias("p"))
    rows = elements.select("elem_id", "ltype", F.filter("nodes", lambda n: n >= 0).alias("nodes")).join(made, "elem_id")
    width = 3 if field is None else 4
    rows = rows.where(F.size("p") == F.size("nodes") * width)  # all corners are known
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = batch.column("ltype").to_numpy()
            for part in _parts(batch, types):
                t = part.column("ltype")[0].as_py()
                p = part.column("p").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1, width)
                found = what(int(t), p[..., :3], *(p[..., k] for k in range(3, width)))
                lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.size // len(x), dtype=np.int32), pa.array(x.ravel())) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("elem_id"), part.column("nodes"), *lists], ["elem_id", "nodes", *names])

    names = columns.split()
    ids, lists = (kinds[c].dataType.simpleString() for c in ("elem_id", "nodes"))
    return rows.mapInArrow(run, f"elem_id {ids}, nodes {lists}, " + ", ".join(f"{c} array<double>" for c in names))


def shares(ltype: int, p: np.ndarray) -> list[np.ndarray]:
    """What each corner's shape function integrates to."""
    return [jacobians(p, ltype)[1] @ rule(ltype)[1]]


def products(ltype: int, p: np.ndarray) -> list[np.ndarray]:
    """What the product of each two shape functions integrates to, row by row."""
    n = rule(ltype)[1]
    return [np.einsum("eg,ga,gb->eab", jacobians(p, ltype)[1], n, n).reshape(len(p), -1)]


def slopes(ltype: int, p: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
    """Shares, and each component of the gradient of f weighted by them."""
    _, n, dn = rule(ltype)
    j, w = jacobians(p, ltype)
    g = np.einsum("egdc,gnd,en->egc", np.linalg.pinv(j), dn, f)
    return [w @ n, *(np.einsum("eg,gn->en", w * g[..., c], n) for c in range(3))]


def lumped_mass(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """The integral of each node's shape function over all element types of :func:`rule`; adds up to the mesh's measure."""
    each = summed(elements, nodes, shares, "share").select(F.explode(F.arrays_zip("nodes", "share")).alias("r"))
    return scatter(each.select(F.col("r.nodes").alias("node_id"), F.col("r.share").alias("share")), "share", "mass")


def consistent_mass(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sparse matrix (i, j, v) of integrals of products of two shape functions, over all element types of :func:`rule`."""
    pair = summed(elements, nodes, products, "v").select("nodes", F.posexplode("v").alias("k", "v"))
    n, k = F.size("nodes"), F.col("k")
    return pair.select(F.get("nodes", F.floor(k / n).cast("int")).alias("i"), F.get("nodes", k % n).alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))


def integral(elements: DataFrame, nodes: DataFrame, field: DataFrame, value: str, mask: str | None = None) -> DataFrame:
    """One row, ``integral``, over the volumes, areas or lengths of elements whose corners are all in the mask."""
    g = gather(elements, field).groupBy("elem_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", value))).alias("f"), F.bool_and(F.col(mask) if mask else F.lit(True)).alias("inside"))
    each = summed(elements, nodes, shares, "share").join(g.where("inside").drop("inside"), "elem_id")
    terms = F.zip_with("nodes", "share", lambda n, w: w * F.col("f")[n])
    return each.agg(F.coalesce(F.sum(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)), F.lit(0.0)).alias("integral"))


def nodal_gradients(elements: DataFrame, nodes: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """(node_id, gx, gy, gz): the gradient at Gauss points of any element type of :func:`rule`, projected to nodes by the lumped mass;
    on surfaces and lines its part along them. Elements without volume have no gradient and must be left out."""
    f = field.select("node_id", F.col(value).cast("double").alias("f"))
    each = summed(elements, nodes, slopes, "w gx gy gz", f).select(F.explode(F.arrays_zip("nodes", "w", "gx", "gy", "gz")).alias("r")).select("r.*")
    return each.groupBy(F.col("nodes").alias("node_id")).agg(*(F.try_divide(F.sum(c), F.sum("w")).alias(c) for c in ("gx", "gy", "gz")))


def triangles_of(elements: DataFrame) -> DataFrame:
    """Quadrilaterals as the triangles (0,1,2) and (2,3,0)."""
    pick = lambda *k: F.array(*(F.get("nodes", F.lit(x)) for x in k))
    quads = elements.where("ltype = 12").select("elem_id", F.posexplode(F.array(pick(0, 1, 2), pick(2, 3, 0))).alias("half", "nodes"))
    return quads.select((2 * F.col("elem_id") + F.col("half")).alias("elem_id"), F.lit(10).alias("ltype"), "nodes")


def gradient(elements: DataFrame, nodes: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """Gradient at nodes of a mesh of plane triangles: constant on each element, weighted by area at its corners."""
    g = gather(elements, nodes.join(field.select("node_id", F.col(value).alias("_f")), "node_id"))
    s = F.struct("pos", "x", "y", "_f")
    e = g.groupBy("elem_id").agg(F.array_sort(F.collect_list(s)).alias("c")).join(elements, "elem_id")
    c = lambda k, f: F.get("c", F.lit(k))[f]
    ux, uy, vx, vy = c(1, "x") - c(0, "x"), c(1, "y") - c(0, "y"), c(2, "x") - c(0, "x"), c(2, "y") - c(0, "y")
    e = e.withColumn("_d", ux * vy - uy * vx).withColumn("_a", c(1, "_f") - c(0, "_f")).withColumn("_b", c(2, "_f") - c(0, "_f"))
    gx, gy = F.try_divide(F.col("_a") * vy - F.col("_b") * uy, F.col("_d")), F.try_divide(F.col("_b") * ux - F.col("_a") * vx, F.col("_d"))
    w = F.abs(F.col("_d"))
    parts = e.select(F.explode("nodes").alias("node_id"), w.alias("w"), (w * gx).alias("gx"), (w * gy).alias("gy"))
    return parts.groupBy("node_id").agg(F.try_divide(F.sum("gx"), F.sum("w")).alias("gx"), F.try_divide(F.sum("gy"), F.sum("w")).alias("gy"))


def divergence(elements: DataFrame, nodes: DataFrame, field: DataFrame, u: str, v: str) -> DataFrame:
    du, dv = gradient(elements, nodes, field, u), gradient(elements, nodes, field, v)
    return du.join(dv.select("node_id", F.col("gy").alias("_gy")), "node_id").select("node_id", (F.col("gx") + F.col("_gy")).alias("div"))


def laplacian(elements: DataFrame, nodes: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """Divergence of the gradient."""
    return divergence(elements, nodes, gradient(elements, nodes, field, value), "gx", "gy").withColumnRenamed("div", "lap")


def solid_gradients(elements: DataFrame, nodes: DataFrame, field: DataFrame, values: list[str]) -> DataFrame:
    """(node_id, one array of three for each value): gradients at nodes of a mesh of tetrahedra, constant on each element and
    weighted by volume at its corners. All values share one gather and one scatter; an element without volume has no weight."""
    g = gather(elements, nodes.join(field.select("node_id", *values), "node_id"))
    s = F.struct("pos", F.array("x", "y", "z").alias("at"), *values)
    e = g.groupBy("elem_id").agg(F.array_sort(F.collect_list(s)).alias("c")).join(elements, "elem_id")
    c = lambda k: F.get("c", F.lit(k))
    for k in (1, 2, 3):
        e = e.withColumn(f"_e{k}", F.zip_with(c(k)["at"], c(0)["at"], lambda a, b: a - b))
    e = e.withColumn("_c1", V.cross(F.col("_e2"), F.col("_e3"))).withColumn("_c2", V.cross(F.col("_e3"), F.col("_e1"))).withColumn("_c3", V.cross(F.col("_e1"), F.col("_e2")))
    e = e.withColumn("_d", V.dot(F.col("_e1"), F.col("_c1")))
    rise = lambda v, axis: V.total([(c(k)[v] - c(0)[v]) * V.comp(F.col(f"_c{k}"), axis) for k in (1, 2, 3)])
    parts = [(F.signum("_d") * rise(v, axis)).alias(f"{v}_{axis}") for v in values for axis in range(3)]  # gradient times volume
    at = e.select(F.explode("nodes").alias("node_id"), F.abs("_d").alias("_w"), *parts)
    mean = lambda v, axis: F.try_divide(F.sum(f"{v}_{axis}"), F.sum("_w"))
    return at.groupBy("node_id").agg(*(F.array(*(mean(v, axis) for axis in range(3))).alias(v) for v in values))


def solid_laplacian(elements: DataFrame, nodes: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """(node_id, lap): the divergence of the gradient, both on tetrahedra and weighted to nodes by volume."""
    g = solid_gradients(elements, nodes, field, [value])
    return solid_divergence(elements, nodes, g.select("node_id", *(V.comp(F.col(value), k).alias(f"_{k}") for k in range(3))), ["_0", "_1", "_2"]).withColumnRenamed("div", "lap")


def solid_divergence(elements: DataFrame, nodes: DataFrame, field: DataFrame, values: list[str]) -> DataFrame:
    """(node_id, div) of the vector with the three ``values``."""
    g = solid_gradients(elements, nodes, field, values)
    return g.select("node_id", V.total([V.comp(F.col(v), k) for k, v in enumerate(values)]).alias("div"))


def to_gauss(elements: DataFrame, nodes: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """(elem_id, gp, value) at the Gauss points of any element type of :func:`rule`."""
    f = field.select("node_id", F.col(value).cast("double").alias("f"))
    made = summed(elements, nodes, lambda t, p, f: [f @ rule(t)[1].T], "v", f)
    return made.select("elem_id", F.posexplode("v").alias("gp", value))


def from_gauss(elements: DataFrame, nodes: DataFrame, gauss: DataFrame, value: str) -> DataFrame:
    """(node_id, value): values at Gauss points (elem_id, gp, value) summed at nodes by weight, volume and shape function, over the sum
    of these, the lumped mass. An element of which points are missing counts with those it has."""
    made = summed(elements, nodes, lambda t, p: [np.einsum("eg,ga->ega", jacobians(p, t)[1], rule(t)[1]).reshape(len(p), -1)], "w")
    n = F.size("nodes")
    parts = gauss.select("elem_id", "gp", value).join(made, "elem_id").select(F.col(value), F.explode(F.arrays_zip("nodes", F.slice("w", F.col("gp") * n + 1, n).alias("w"))).alias("c"))
    return parts.groupBy(F.col("c.nodes").alias("node_id")).agg(F.try_divide(F.sum(F.col("c.w") * F.col(value)), F.sum("c.w")).alias(value))


def boundary(elements: DataFrame) -> DataFrame:
    """Edges of plane elements that only one element has, as (a, b) with a < b."""
    n = F.size("nodes")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("nodes", k).alias("p"), F.get("nodes", (k + 1) % n).alias("q")))
    e = elements.select(F.explode(pairs).alias("e")).select(F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b"))
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("a", "b")


def periodic(nodes: DataFrame, axis: str, low: float, high: float, tol: float = 1e-10) -> DataFrame:
    """(master, slave) of nodes on two boundary planes with the same other coordinates; the largest id of a place wins."""
    key = [c for c in ("x", "y", "z") if c != axis]
    rounded = [F.round(c, 9).alias(f"_{c}") for c in key]
    side = lambda v, n: nodes.where(F.abs(F.col(axis) - v) < tol).groupBy(*rounded).agg(F.max("node_id").alias(n))
    return side(low, "master").join(side(high, "slave"), [f"_{c}" for c in key]).select("master", "slave")


def masters(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every node its master, or 0."""
    return nodes.select("node_id").join(pairs.select(F.col("slave").alias("node_id"), "master"), "node_id", "left").select("node_id", F.coalesce("master", F.lit(0)).alias("master"))


def rooted(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(master, slave) with chains resolved: every node points to the smallest node it is linked to."""
    both = pairs.select(F.col("master").alias("a"), F.col("slave").alias("b")).unionByName(pairs.select(F.col("slave").alias("a"), F.col("master").alias("b"))).distinct()
    both = cut_lineage(both)
    label = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    for _ in range(rounds):
        step = both.join(label.select(F.col("a").alias("b"), F.col("m").alias("n")), "b").groupBy("a").agg(F.min("n").alias("n"))
        new = label.join(step, "a").select("a", F.least("m", "n").alias("m"), (F.col("n") < F.col("m")).alias("moved"))
        new = cut_lineage(new)
        moved = new.where("moved").limit(1).count()
        label = new.select("a", "m")
        if not moved:
            break
    return label.where("a <> m").select(F.col("m").alias("master"), F.col("a").alias("slave"))


def perimeter(edges: DataFrame, resolution: float) -> DataFrame:
    """Points along segments (x0, y0, x1, y1): both ends, and steps of at least ``resolution`` between."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    n = F.greatest(F.floor(length / resolution).cast("int"), F.lit(1))
    k = edges.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    return k.select("edge_id", "k", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def walls(rings: DataFrame, base: Column, top: Column) -> DataFrame:
    """Two triangles for each edge of closed rings (id, pt_no, x, y), between two heights; labelled as walls."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("pt_no")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    e = rings.withColumn("x2", nxt("x")).withColumn("y2", nxt("y"))
    p = lambda x, y, z: F.array(F.col(x), F.col(y), z)
    lower, upper = (p("x", "y", base), p("x2", "y2", base)), (p("x", "y", top), p("x2", "y2", top))
    faces = F.array(F.array(lower[0], lower[1], upper[1]), F.array(upper[1], upper[0], lower[0]))
    return e.select("id", "pt_no", F.posexplode(faces).alias("half", "triangle"), F.lit("WallSurface").alias("semantics"))
