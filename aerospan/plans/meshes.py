"""Mesh, finite-element, periodicity and sparse-matrix queries. Parts are the nodes of the meshes, so these grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospan.functions.shapes import rule
from aerospan.operators import mesh as M
from aerospan.operators import sparse as P
from aerospan.registry import query, rounded, table
from aerospan.session import cut_lineage

#: Nodes along the first axis of the plane; its cells are parallelograms of area CELL.
N1, CELL = 21, 0.01
#: In SQL: nodes, elements (by their first node) and corners of the plane.
NODES = f"n AS (SELECT p_partkey AS node_id, p_partkey % {N1} AS i, p_partkey // {N1} AS j, (p_partkey % {N1}) * 0.1::DOUBLE + (p_partkey // {N1}) * 0.03::DOUBLE AS x, (p_partkey // {N1}) * 0.1::DOUBLE AS y, p_retailprice AS f, p_size::DOUBLE AS g, p_size > 5 AS inside FROM part)"
ELEMS = f"e AS (SELECT a.p_partkey AS elem_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + {N1 + 1} WHERE a.p_partkey % {N1} < {N1 - 1})"
CORNERS = f"c AS (SELECT elem_id, pos, elem_id + step AS node_id FROM e, (VALUES (0, 0), (1, {N1}), (2, {N1 + 1}), (3, 1)) t(pos, step))"


def plane(spark, sf_dir):
    """A node for each part on a sheared lattice, with fields f and g, and a quadrilateral at each node that has its three others."""
    k = F.col("p_partkey")
    i, j = k % N1, F.floor(k / N1)
    nodes = table(spark, sf_dir, "part").select(k.alias("node_id"), (i * 0.1 + j * 0.03).alias("x"), (j * 0.1).alias("y"), F.lit(0.0).alias("z"), F.col("p_retailprice").alias("f"), F.col("p_size").cast("double").alias("g"), (F.col("p_size") > 5).alias("inside"))
    n = F.col("node_id")
    first = nodes.where(n % N1 < N1 - 1).select(n).join(nodes.select((n - N1 - 1).alias("node_id")), "node_id")
    elements = first.select(n.alias("elem_id"), F.lit(12).alias("ltype"), F.array(n, n + N1, n + N1 + 1, n + 1).alias("nodes"))
    return nodes.select("node_id", "x", "y", "z"), elements, nodes.select("node_id", "f", "g", "inside")


def layers(spark, sf_dir, each: int) -> int:
    """As many layers of ``each`` nodes as the parts fill, and two."""
    return 2 + table(spark, sf_dir, "part").count() // each


#: In SQL: the same number as ``n``.
LAYERS = "m AS (SELECT 2 + count(*) // {} AS n FROM part)".format


@query(f"WITH {LAYERS(N1)} SELECT i + j * {N1} AS node_id, round(i * 2.0 / {N1 - 1}, 6)::DOUBLE AS x, round(0.5 * (1 + tanh(0.2 * (2 * (j / (n - 1)) - 1)) / tanh(0.2)), 6) AS y FROM m, range(0, {N1}) a(i), unnest(range(0, n)) b(j)")
def plane_mesh(spark, sf_dir):
    return M.plane_nodes(spark, (2.0, 1.0), N1, layers(spark, sf_dir, N1), conc=2).select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(f"WITH {LAYERS(N1)} SELECT i * (n - 1) + j AS elem_id, i + j * {N1} AS a, i + (j + 1) * {N1} AS b, i + 1 + (j + 1) * {N1} AS c, i + 1 + j * {N1} AS d FROM m, range(0, {N1 - 1}) a(i), unnest(range(0, n - 1)) b(j)")
def plane_connectivity(spark, sf_dir):
    return M.plane_elements(spark, N1, layers(spark, sf_dir, N1)).select("elem_id", *(F.get("nodes", F.lit(k)).alias(n) for k, n in enumerate("abcd")))


@query(f"WITH {LAYERS(20)} SELECT i + j * 5 + k * 20 AS node_id, round(i * 0.25, 6)::DOUBLE AS x, round(j * 2.0 / 3, 6)::DOUBLE AS y, round(k * 3 / (n - 1), 6) AS z FROM m, range(0, 5) a(i), range(0, 4) b(j), unnest(range(0, n)) c(k)")
def cube_mesh(spark, sf_dir):
    return M.cube_nodes(spark, (1.0, 2.0, 3.0), 5, 4, layers(spark, sf_dir, 20)).select("node_id", *(rounded(F.col(c)).alias(c) for c in "xyz"))


@query(f"WITH {LAYERS(20)} SELECT (i * 3 + j) * (n - 1) + k AS elem_id, i + j * 5 + k * 20 AS first, (i + 1) + (j + 1) * 5 + (k + 1) * 20 AS opposite FROM m, range(0, 4) a(i), range(0, 3) b(j), unnest(range(0, n - 1)) c(k)")
def cube_connectivity(spark, sf_dir):
    return M.cube_elements(spark, 5, 4, layers(spark, sf_dir, 20)).select("elem_id", F.get("nodes", F.lit(0)).alias("first"), F.get("nodes", F.lit(6)).alias("opposite"))


@query(f"WITH {NODES} SELECT (i // 2 + (j // 2) * {(N1 + 1) // 2})::BIGINT AS node_id, round(x, 6) AS x, round(y, 6) AS y FROM n WHERE i % 2 = 0 AND j % 2 = 0")
def mesh_decimate(spark, sf_dir):
    return M.decimate(plane(spark, sf_dir)[0], N1, 0, 2).select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(f"WITH {NODES}, {ELEMS}, {CORNERS} SELECT elem_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, 0.0::DOUBLE AS z FROM c JOIN n USING (node_id) GROUP BY elem_id")
def cell_centers(spark, sf_dir):
    nodes, elements, _ = plane(spark, sf_dir)
    return M.centers(elements, nodes).select("elem_id", *(rounded(F.col(c)).alias(c) for c in "xyz"))


@query(f"WITH {ELEMS}, {CORNERS} SELECT node_id, round(count(*) * {CELL}::DOUBLE / 4, 8) AS mass FROM c GROUP BY node_id")
def lumped_mass(spark, sf_dir):
    nodes, elements, _ = plane(spark, sf_dir)
    return M.lumped_mass(elements, nodes).select("node_id", rounded(F.col("mass"), 8).alias("mass"))


@query(f"WITH {ELEMS}, {CORNERS} SELECT a.node_id AS i, b.node_id AS j, round(sum({CELL}::DOUBLE * CASE (a.pos - b.pos + 4) % 4 WHEN 0 THEN 4.0 WHEN 2 THEN 1.0 ELSE 2.0 END / 36), 9) AS v FROM c a JOIN c b USING (elem_id) GROUP BY 1, 2")
def consistent_mass(spark, sf_dir):
    nodes, elements, _ = plane(spark, sf_dir)
    return M.consistent_mass(elements, nodes).select("i", "j", rounded(F.col("v"), 9).alias("v"))


@query(f"WITH {NODES}, {ELEMS}, {CORNERS}, g AS (SELECT elem_id, avg(f) AS f, bool_and(inside) AS ok FROM c JOIN n USING (node_id) GROUP BY elem_id) SELECT round(sum({CELL}::DOUBLE * f), 6) AS integral FROM g WHERE ok")
def integral_masked(spark, sf_dir):
    nodes, elements, field = plane(spark, sf_dir)
    return M.integral(elements, nodes, field, "f", "inside").select(rounded(F.col("integral"), 6).alias("integral"))


@query(f"WITH {NODES}, {ELEMS}, {CORNERS} SELECT elem_id, pos, node_id, round(f, 6) AS f FROM c JOIN n USING (node_id)")
def gather_field(spark, sf_dir):
    _, elements, field = plane(spark, sf_dir)
    return M.gather(elements, field).select("elem_id", "pos", "node_id", rounded(F.col("f")).alias("f"))


@query(f"WITH {NODES}, {ELEMS}, {CORNERS} SELECT node_id, round(sum(f), 6) AS total FROM (SELECT elem_id, avg(f) AS f FROM c JOIN n USING (node_id) GROUP BY elem_id) JOIN c USING (elem_id) GROUP BY node_id")
def scatter_add(spark, sf_dir):
    _, elements, field = plane(spark, sf_dir)
    means = M.gather(elements, field).groupBy("elem_id").agg(F.avg("f").alias("f"))
    return M.scatter(M.corners(elements).join(means, "elem_id"), "f", "total").select("node_id", rounded(F.col("total")).alias("total"))


@query(f"WITH {ELEMS}, {CORNERS} SELECT DISTINCT a.node_id, b.node_id AS other FROM c a JOIN c b USING (elem_id) WHERE a.node_id <> b.node_id")
def node_neighbours(spark, sf_dir):
    return M.neighbours(plane(spark, sf_dir)[1])


#: In SQL: the two triangles of each quadrilateral, and at their corners area, and area times the slopes of f and g.
HALVES = f"t AS (SELECT 2 * elem_id AS tri, elem_id AS a, elem_id + {N1} AS b, elem_id + {N1 + 1} AS c FROM e UNION ALL SELECT 2 * elem_id + 1, elem_id + {N1 + 1}, elem_id + 1, elem_id FROM e)"
SLOPES = f"""{NODES}, {ELEMS}, {HALVES},
s AS (SELECT a, b, c, q.x - p.x AS ux, q.y - p.y AS uy, r.x - p.x AS vx, r.y - p.y AS vy, q.f - p.f AS fu, r.f - p.f AS fv, q.g - p.g AS gu, r.g - p.g AS gv FROM t JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b JOIN n r ON r.node_id = c),
w AS (SELECT unnest([a, b, c]) AS node_id, abs(ux * vy - uy * vx) AS w, sign(ux * vy - uy * vx) * (fu * vy - fv * uy) AS fx, sign(ux * vy - uy * vx) * (fv * ux - fu * vx) AS fy, sign(ux * vy - uy * vx) * (gv * ux - gu * vx) AS gy FROM s)"""


@query(f"WITH {ELEMS}, {HALVES} SELECT tri AS elem_id, a, b, c FROM t")
def quad_to_triangles(spark, sf_dir):
    return M.triangles_of(plane(spark, sf_dir)[1]).select("elem_id", *(F.get("nodes", F.lit(k)).alias(c) for k, c in enumerate("abc")))


#: In SQL: the shape functions of the quadrilateral at its Gauss points.
SHAPES = "s(gp, pos, w) AS (VALUES " + ", ".join(f"({g}, {p}, {v}::DOUBLE)" for g, row in enumerate(rule(12)[1].tolist()) for p, v in enumerate(row)) + ")"


@query(f"WITH {NODES}, {ELEMS}, {CORNERS}, {SHAPES} SELECT elem_id, gp, round(sum(w * f), 6) AS f FROM c JOIN n USING (node_id) JOIN s USING (pos) GROUP BY elem_id, gp")
def nodes_to_gauss(spark, sf_dir):
    nodes, elements, field = plane(spark, sf_dir)
    return M.to_gauss(elements, nodes, field, "f").select("elem_id", "gp", rounded(F.col("f")).alias("f"))


@query(f"WITH {NODES}, {ELEMS}, {CORNERS}, {SHAPES}, g AS (SELECT elem_id, gp, sum(w * f) AS f FROM c JOIN n USING (node_id) JOIN s USING (pos) GROUP BY elem_id, gp) SELECT node_id, round(sum(w * f) / sum(w), 6) AS f FROM g JOIN s USING (gp) JOIN c ON c.elem_id = g.elem_id AND c.pos = s.pos GROUP BY node_id")
def gauss_to_nodes(spark, sf_dir):
    nodes, elements, field = plane(spark, sf_dir)
    return M.from_gauss(elements, nodes, M.to_gauss(elements, nodes, field, "f"), "f").select("node_id", rounded(F.col("f")).alias("f"))


@query(f"WITH {SLOPES} SELECT node_id, round(sum(fx) / sum(w), 5) AS gx, round(sum(fy) / sum(w), 5) AS gy FROM w GROUP BY node_id")
def gradient_linear(spark, sf_dir):
    """Of the price, on triangles."""
    nodes, elements, field = plane(spark, sf_dir)
    g = M.gradient(M.triangles_of(elements), nodes, field, "f")
    return g.select("node_id", rounded(F.col("gx"), 5).alias("gx"), rounded(F.col("gy"), 5).alias("gy"))


@query(f"WITH {SLOPES} SELECT node_id, round((sum(fx) + sum(gy)) / sum(w), 5) AS div FROM w GROUP BY node_id")
def divergence_linear(spark, sf_dir):
    """Of the vector (price, size), on triangles."""
    nodes, elements, field = plane(spark, sf_dir)
    return M.divergence(M.triangles_of(elements), nodes, field, "f", "g").select("node_id", rounded(F.col("div"), 5).alias("div"))


@query(f"""WITH {SLOPES}, r AS (SELECT node_id, sum(fx) / sum(w) AS gx, sum(fy) / sum(w) AS gy FROM w GROUP BY node_id),
d AS (SELECT s.*, q.gx - p.gx AS xu, r.gx - p.gx AS xv, q.gy - p.gy AS yu, r.gy - p.gy AS yv FROM s JOIN r p ON p.node_id = a JOIN r q ON q.node_id = b JOIN r ON r.node_id = c),
l AS (SELECT unnest([a, b, c]) AS node_id, abs(ux * vy - uy * vx) AS w, sign(ux * vy - uy * vx) * (xu * vy - xv * uy + yv * ux - yu * vx) AS lap FROM d)
SELECT node_id, round(sum(lap) / sum(w), 4) AS lap FROM l GROUP BY node_id""")
def laplacian_field(spark, sf_dir):
    nodes, elements, field = plane(spark, sf_dir)
    return M.laplacian(M.triangles_of(elements), nodes, field, "f").select("node_id", rounded(F.col("lap"), 4).alias("lap"))


@query(f"WITH {ELEMS}, {CORNERS}, p AS (SELECT a.elem_id, least(a.node_id, b.node_id) AS a, greatest(a.node_id, b.node_id) AS b FROM c a JOIN c b ON a.elem_id = b.elem_id AND b.pos = (a.pos + 1) % 4) SELECT a, b FROM p GROUP BY a, b HAVING count(*) = 1")
def boundary_edges(spark, sf_dir):
    return M.boundary(plane(spark, sf_dir)[1])


#: In SQL: parts as nodes of a box, five by four a layer.
CUBE = "q AS (SELECT p_partkey AS node_id, p_partkey % 5 AS i, p_partkey // 5 % 4 AS j, p_partkey // 20 AS k FROM part)"


def cube(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("node_id"), ((k % 5) * 0.25).alias("x"), ((F.floor(k / 5) % 4) * 0.5).alias("y"), (F.floor(k / 20) * 1.5).alias("z"))


@query(f"WITH {CUBE} SELECT a.node_id AS master, b.node_id AS slave FROM q a JOIN q b ON a.j = b.j AND a.k = b.k WHERE a.i = 0 AND b.i = 4")
def periodic_pairs(spark, sf_dir):
    return M.periodic(cube(spark, sf_dir), "x", 0.0, 1.0)


@query(f"WITH {CUBE} SELECT q.node_id, coalesce(a.node_id, 0) AS master FROM q LEFT JOIN q a ON q.i = 4 AND a.i = 0 AND a.j = q.j AND a.k = q.k")
def master_list(spark, sf_dir):
    nodes = cube(spark, sf_dir)
    return M.masters(M.periodic(nodes, "x", 0.0, 1.0), nodes)


@query(f"WITH {CUBE} SELECT (i % 4) + (j % 3) * 5 + k * 20 AS master, node_id AS slave FROM q WHERE i = 4 OR j = 3")
def periodic_unique(spark, sf_dir):
    """Two periodic directions: corners are linked in chains."""
    nodes = cube(spark, sf_dir)
    return M.rooted(M.periodic(nodes, "x", 0.0, 1.0).unionByName(M.periodic(nodes, "y", 0.0, 1.5)))


@query("SELECT p_partkey AS edge_id, k, round(p_size * k / n::DOUBLE, 6) AS x, round(p_size * 2.0 * k / n, 6)::DOUBLE AS y FROM (SELECT p_partkey, p_size, greatest(floor(sqrt(5.0) * p_size / 10.0)::INT, 1) AS n, unnest(range(0, greatest(floor(sqrt(5.0) * p_size / 10.0)::INT, 1) + 1)) AS k FROM part)")
def perimeter_points(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("edge_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p_size").cast("double").alias("x1"), (2.0 * F.col("p_size")).alias("y1"))
    return M.perimeter(e, 10.0).select("edge_id", F.col("k").cast("long").alias("k"), rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


#: In SQL: the corners of each part's footprint and the next ones.
WALLS = "f AS (SELECT p_partkey AS id, pt_no, p_partkey * x AS x, y, p_partkey * x2 AS x2, y2, p_retailprice AS h FROM part, (VALUES (0, 0, 0, 1, 0), (1, 1, 0, 1, 1), (2, 1, 1, 0, 1), (3, 0, 1, 0, 0)) c(pt_no, x, y, x2, y2))"


@query(f"WITH {WALLS} SELECT id, pt_no, 0 AS half, x::DOUBLE AS ax, y::DOUBLE AS ay, 0.0::DOUBLE AS az, x2::DOUBLE AS bx, y2::DOUBLE AS b_y, 0.0::DOUBLE AS bz, x2::DOUBLE AS cx, y2::DOUBLE AS cy, h AS cz, 'WallSurface' AS semantics FROM f UNION ALL SELECT id, pt_no, 1, x2, y2, h, x, y, h, x, y, 0.0, 'WallSurface' FROM f")
def building_walls(spark, sf_dir):
    """Extruded footprints: a rectangle for each part, as high as its price."""
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("h"), F.posexplode(F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))).alias("pt_no", "p"))
    rings = r.select("id", "pt_no", (F.get("p", F.lit(0)) * F.col("id")).alias("x"), F.get("p", F.lit(1)).alias("y"), "h")
    w = M.walls(rings, F.lit(0.0), F.col("h"))
    return w.select("id", "pt_no", "half", *(F.get(F.get("triangle", F.lit(k)), F.lit(c)).alias(f"{p}{'_' if p + n == 'by' else ''}{n}") for k, p in enumerate("abc") for c, n in enumerate("xyz")), "semantics")


COO = "a AS (SELECT (l_partkey % 100)::INT AS i, (l_suppkey % 100)::INT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def coo(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 100).cast("int").alias("i"), (F.col("l_suppkey") % 100).cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {COO} SELECT i, round(sum(v * (j + 1)), 4) AS y FROM a GROUP BY i")
def spmv(spark, sf_dir):
    x = spark.range(100).select(F.col("id").cast("int").alias("j"), (F.col("id") + 1).cast("double").alias("x"))
    return P.times_vector(coo(spark, sf_dir), x).select("i", rounded(F.col("y"), 4).alias("y"))


@query(f"WITH {COO} SELECT a.i, b.i AS j, round(sum(a.v * b.v), 4) AS v FROM a JOIN a b ON a.j = b.j GROUP BY 1, 2")
def spmm(spark, sf_dir):
    a = coo(spark, sf_dir)
    return P.times_matrix(a, P.transpose(a)).select("i", "j", rounded(F.col("v"), 4).alias("v"))


@query(f"WITH {COO} SELECT (SELECT sum(v) FROM a WHERE i = j) AS trace, (SELECT count(*) FROM a WHERE i = j) AS diagonal, (SELECT sum(v * (i - j)) FROM a) AS skew")
def csr_transpose_trace(spark, sf_dir):
    a = coo(spark, sf_dir)
    return P.trace(a).crossJoin(P.diagonal(a).agg(F.count(F.lit(1)).alias("diagonal"))).crossJoin(P.transpose(a).agg(F.sum(F.col("v") * (F.col("j") - F.col("i"))).alias("skew")))


@query("SELECT s_suppkey AS i, j, (s_suppkey + 1) * 10 + j AS v FROM supplier, range(0, 9) b(j) WHERE (s_suppkey + j) % 2 = 0")
def binary_matrix(spark, sf_dir):
    """An implicit matrix op(row, column) of as many rows as there are suppliers and nine columns."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    return P.from_rule(rows, 9, lambda i, j: F.when((i + j) % 2 == 0, (i + 1) * 10 + j))


#: In SQL: sizes of the parts that a mesh's elements have as corners.
SIZES = f"WITH {ELEMS}, {CORNERS} SELECT p_partkey AS i, p_size::DOUBLE AS x FROM part WHERE p_partkey IN (SELECT node_id FROM c)"


def system(spark, sf_dir):
    """The mass matrix of the plane, and what it makes of the sizes."""
    nodes, elements, field = plane(spark, sf_dir)
    a = cut_lineage(M.consistent_mass(elements, nodes))
    return a, P.times_vector(a, field.select(F.col("node_id").alias("j"), F.col("g").alias("x"))).withColumnRenamed("y", "b")


@query(SIZES)
def conj_grad(spark, sf_dir):
    """Finds the sizes again."""
    a, b = system(spark, sf_dir)
    return P.conjugate_gradient(a, b).select("i", rounded(F.col("x"), 3).alias("x"))


@query()
def approx_inverse(spark, sf_dir):
    a, b = system(spark, sf_dir)
    return P.approximate_inverse(a, b, 25).select("i", rounded(F.col("x"), 5).alias("x"))


@query(f"WITH {ELEMS}, {CORNERS}, m AS (SELECT node_id, count(*) * {CELL}::DOUBLE / 4 AS m FROM c GROUP BY node_id) SELECT node_id AS i, round(p_retailprice / m, 5) AS x FROM m JOIN part ON p_partkey = node_id")
def lumped_solve(spark, sf_dir):
    """Prices over the lumped mass."""
    nodes, elements, field = plane(spark, sf_dir)
    m = M.lumped_mass(elements, nodes).select(F.col("node_id").alias("i"), F.col("mass").alias("m"))
    return P.lumped(m, field.select(F.col("node_id").alias("i"), F.col("f").alias("b"))).select("i", rounded("x", 5).alias("x"))
