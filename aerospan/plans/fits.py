"""Fitted planes, neighbourhood features, tetrahedra, moment tensors and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospan.functions import vectors as V
from aerospan.operators import faces as B
from aerospan.operators import locate as L
from aerospan.operators import mesh as M
from aerospan.operators import series as S
from aerospan.operators import signals as G
from aerospan.operators import statistics as A
from aerospan.plans.spatial import SERIES, samples
from aerospan.plans.statistics import EVENTS, events
from aerospan.registry import query, rounded, table

COORDS = ["x", "y", "z"]


def cloud(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100 + F.col("l_quantity") / 10).alias("z"))


#: In SQL: the same points, the covariance by flag, its eigenvalues e0 <= e1 <= e2 and the normal (the row space's complement).
PCA = """p AS (SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 + l_quantity / 10 AS z FROM lineitem),
c AS (SELECT flag, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, var_pop(x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, var_pop(y) AS yy, covar_pop(y, z) AS yz, var_pop(z) AS zz FROM p GROUP BY flag),
q AS (SELECT *, (xx + yy + zz) / 3 AS m, sqrt((pow(xx - (xx + yy + zz) / 3, 2) + pow(yy - (xx + yy + zz) / 3, 2) + pow(zz - (xx + yy + zz) / 3, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM c),
w AS (SELECT *, acos(greatest(-1.0, least(1.0, ((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * s * s * s)))) / 3 AS a FROM q),
g AS (SELECT *, m + 2 * s * cos(a + 2 * pi() / 3) AS e0, 3 * m - (m + 2 * s * cos(a + 2 * pi() / 3)) - (m + 2 * s * cos(a)) AS e1, m + 2 * s * cos(a) AS e2 FROM w),
u AS (SELECT *, xy * yz - xz * (yy - e0) AS ux, xz * xy - (xx - e0) * yz AS uy, (xx - e0) * (yy - e0) - xy * xy AS uz FROM g),
f AS (SELECT *, ux / sqrt(ux * ux + uy * uy + uz * uz) * sign(uz) AS nx, uy / sqrt(ux * ux + uy * uy + uz * uz) * sign(uz) AS ny, abs(uz) / sqrt(ux * ux + uy * uy + uz * uz) AS nz FROM u)"""


@query(f"WITH {PCA} SELECT flag, n, round(cx, 5) AS cx, round(cy, 5) AS cy, round(cz, 5) AS cz, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz, round(sqrt(e0), 5) AS rms FROM f")
def plane_fit(spark, sf_dir):
    p = A.fitted_plane(cloud(spark, sf_dir), ["flag"], COORDS)
    normal = [rounded(V.comp(F.col("normal"), k), 5).alias(c) for k, c in enumerate(("nx", "ny", "nz"))]
    return p.select("flag", "n", *(rounded(F.col(c), 5).alias(c) for c in ("cx", "cy", "cz")), *normal, rounded(F.col("rms"), 5).alias("rms"))


@query(f"WITH {PCA} SELECT l_orderkey, l_linenumber, round(abs((x - cx) * nx + (y - cy) * ny + (z - cz) * nz), 4) AS distance FROM p JOIN f ON p.flag = f.flag")
def plane_distance(spark, sf_dir):
    d = A.plane_distance(cloud(spark, sf_dir), ["flag"], COORDS)
    return d.select("l_orderkey", "l_linenumber", rounded(F.col("distance"), 4).alias("distance"))


@query(f"WITH {PCA} SELECT flag, round(e0 / (e0 + e1 + e2), 6) AS low, round(e1 / (e0 + e1 + e2), 6) AS middle, round(e2 / (e0 + e1 + e2), 6) AS high, round((e2 - e1) / e2, 6) AS linearity, round((e1 - e0) / e2, 6) AS planarity, round(e0 / e2, 6) AS sphericity FROM g")
def eigen_features(spark, sf_dir):
    e = A.eigen_features(cloud(spark, sf_dir), ["flag"], COORDS)
    return e.select("flag", *(rounded(F.col(c)).alias(c) for c in ("low", "middle", "high", "linearity", "planarity", "sphericity")))


@query("""WITH t AS (SELECT c_custkey, min(c_custkey % 100) AS place FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey)
SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS o_orderkey, any_value(place) AS place FROM orders JOIN t ON o_custkey = c_custkey GROUP BY o_custkey""")
def node_reorder(spark, sf_dir):
    """One order for each customer of the target, with the customer's first place there; the target names each twice."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 100).alias("place"))
    twice = c.unionByName(c.withColumn("place", F.col("place") + 1))
    return A.in_numbering(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), twice, "o_custkey", "place", ["o_orderkey"])


def solids(spark, sf_dir):
    """A node for each part on a sheared lattice, and a tetrahedron at each node that has its three neighbours."""
    k = F.col("p_partkey")
    i, j, l = k % 5, F.floor(k / 5) % 5, F.floor(k / 25)
    nodes = table(spark, sf_dir, "part").select(k.alias("node_id"), (i + 0.3 * j + 0.1 * i * i).alias("x"), (j + 0.2 * l).alias("y"), (1.5 * l + 0.1 * i * j).alias("z"), i.alias("i"), j.alias("j"), F.col("p_retailprice").alias("f"), F.col("p_size").cast("double").alias("g"))
    ids = nodes.select(F.col("node_id").alias("top"))
    n = F.col("node_id")
    elements = nodes.where("i < 4 and j < 4").join(ids, n + 25 == F.col("top")).select(n.alias("elem_id"), F.lit(30).alias("ltype"), F.array(n, n + 1, n + 5, n + 25).alias("nodes"))
    return nodes.select("node_id", "x", "y", "z", "f", "g"), elements


#: In SQL: the same solids; by Cramer's rule, the numerators of each element's gradients of f and g, and its determinant.
SOLIDS = """k AS (SELECT p_partkey::BIGINT AS id, (p_partkey % 5)::DOUBLE AS i, (p_partkey // 5 % 5)::DOUBLE AS j, (p_partkey // 25)::DOUBLE AS l, p_retailprice AS f, p_size::DOUBLE AS g FROM part),
n AS (SELECT id, i, j, i + 0.3 * j + 0.1 * i * i AS x, j + 0.2 * l AS y, 1.5 * l + 0.1 * i * j AS z, f, g FROM k),
d AS (SELECT o.id, a.x - o.x AS ax, a.y - o.y AS ay, a.z - o.z AS az, b.x - o.x AS bx, b.y - o.y AS b_y, b.z - o.z AS bz, c.x - o.x AS cx, c.y - o.y AS cy, c.z - o.z AS cz, a.f - o.f AS fa, b.f - o.f AS fb, c.f - o.f AS fc, a.g - o.g AS ga, b.g - o.g AS gb, c.g - o.g AS gc
 FROM n o JOIN n a ON a.id = o.id + 1 JOIN n b ON b.id = o.id + 5 JOIN n c ON c.id = o.id + 25 WHERE o.i < 4 AND o.j < 4),
e AS (SELECT id, ax * (b_y * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - b_y * cx) AS det,
 fa * (b_y * cz - bz * cy) - ay * (fb * cz - bz * fc) + az * (fb * cy - b_y * fc) AS fx, ax * (fb * cz - bz * fc) - fa * (bx * cz - bz * cx) + az * (bx * fc - fb * cx) AS fy, ax * (b_y * fc - fb * cy) - ay * (bx * fc - fb * cx) + fa * (bx * cy - b_y * cx) AS fz,
 ax * (gb * cz - bz * gc) - ga * (bx * cz - bz * cx) + az * (bx * gc - gb * cx) AS gy FROM d),
m AS (SELECT unnest([id, id + 1, id + 5, id + 25]) AS node_id, abs(det) AS w, sign(det) * fx AS fx, sign(det) * fy AS fy, sign(det) * fz AS fz, sign(det) * gy AS gy FROM e)"""


@query(f"WITH {SOLIDS} SELECT node_id, round(sum(fx) / sum(w), 5) AS gx, round(sum(fy) / sum(w), 5) AS gy, round(sum(fz) / sum(w), 5) AS gz FROM m GROUP BY node_id")
def gradient_solid(spark, sf_dir):
    nodes, elements = solids(spark, sf_dir)
    g = M.solid_gradients(elements, nodes.select("node_id", *COORDS), nodes, ["f"])
    return g.select("node_id", *(rounded(V.comp(F.col("f"), k), 5).alias(c) for k, c in enumerate(("gx", "gy", "gz"))))


@query(f"WITH {SOLIDS} SELECT node_id, round((sum(fx) + sum(gy)) / sum(w), 5) AS div FROM m GROUP BY node_id")
def divergence_solid(spark, sf_dir):
    """Of the vector (price, size, 1)."""
    nodes, elements = solids(spark, sf_dir)
    field = nodes.select("node_id", "f", "g", F.lit(1.0).alias("h"))
    return M.solid_divergence(elements, nodes.select("node_id", *COORDS), field, ["f", "g", "h"]).select("node_id", rounded(F.col("div"), 5).alias("div"))


@query(f"""WITH {SOLIDS}, r AS (SELECT node_id, sum(fx) / sum(w) AS gx, sum(fy) / sum(w) AS gy, sum(fz) / sum(w) AS gz FROM m GROUP BY node_id),
v AS (SELECT d.*, e.det, a.gx - o.gx AS ux, b.gx - o.gx AS vx, c.gx - o.gx AS wx, a.gy - o.gy AS uy, b.gy - o.gy AS vy, c.gy - o.gy AS wy, a.gz - o.gz AS uz, b.gz - o.gz AS vz, c.gz - o.gz AS wz
 FROM d JOIN e ON e.id = d.id JOIN r o ON o.node_id = d.id JOIN r a ON a.node_id = d.id + 1 JOIN r b ON b.node_id = d.id + 5 JOIN r c ON c.node_id = d.id + 25),
t AS (SELECT id, det, ux * (b_y * cz - bz * cy) - ay * (vx * cz - bz * wx) + az * (vx * cy - b_y * wx) + ax * (vy * cz - bz * wy) - uy * (bx * cz - bz * cx) + az * (bx * wy - vy * cx)
 + ax * (b_y * wz - vz * cy) - ay * (bx * wz - vz * cx) + uz * (bx * cy - b_y * cx) AS lap FROM v),
p AS (SELECT unnest([id, id + 1, id + 5, id + 25]) AS node_id, abs(det) AS w, sign(det) * lap AS lap FROM t)
SELECT node_id, round(sum(lap) / sum(w), 5) AS lap FROM p GROUP BY node_id""")
def laplacian_solid(spark, sf_dir):
    nodes, elements = solids(spark, sf_dir)
    return M.solid_laplacian(elements, nodes.select("node_id", *COORDS), nodes, "f").select("node_id", rounded("lap", 5).alias("lap"))


def boxes(spark, sf_dir):
    """A node for each part on a sheared lattice of cells of volume 1.5, and a hexahedron at each node that has its seven others."""
    k = F.col("p_partkey")
    i, j, l = k % 5, F.floor(k / 5) % 5, F.floor(k / 25)
    nodes = table(spark, sf_dir, "part").select(k.alias("node_id"), (i + 0.3 * j).alias("x"), (j + 0.2 * l).alias("y"), (1.5 * l).alias("z"), i.alias("i"), j.alias("j"), F.col("p_retailprice").alias("f"), (F.col("p_size") > 2).alias("inside"))
    n = F.col("node_id")
    elements = nodes.where("i < 4 and j < 4").join(nodes.select((n - 31).alias("_o")), n == F.col("_o"))
    return nodes, elements.select(n.alias("elem_id"), F.lit(37).alias("ltype"), F.array(*(n + d for d in (0, 1, 6, 5, 25, 26, 31, 30))).alias("nodes"))


#: In SQL: corners (elem_id, node, and 0 or 1 along each axis) of the same hexahedra.
BOXES = """o AS (SELECT p_partkey::BIGINT AS e FROM part WHERE p_partkey % 5 < 4 AND p_partkey // 5 % 5 < 4 AND p_partkey + 31 IN (SELECT p_partkey FROM part)),
c AS (SELECT e, e + a + 5 * b + 25 * d AS node, a, b, d FROM o, range(2) x(a), range(2) y(b), range(2) z(d))"""


@query(f"WITH {BOXES} SELECT s.node AS i, t.node AS j, round(sum(1.5 * CASE WHEN s.a = t.a THEN 2 ELSE 1 END * CASE WHEN s.b = t.b THEN 2 ELSE 1 END * CASE WHEN s.d = t.d THEN 2 ELSE 1 END / 216), 9) AS v FROM c s JOIN c t ON s.e = t.e GROUP BY 1, 2")
def consistent_mass_solid(spark, sf_dir):
    nodes, elements = boxes(spark, sf_dir)
    return M.consistent_mass(elements, nodes).select("i", "j", rounded(F.col("v"), 9).alias("v"))


@query(f"WITH {BOXES}, m AS (SELECT e, avg(p_retailprice) AS f FROM c JOIN part ON p_partkey = node GROUP BY e HAVING bool_and(p_size > 2)) SELECT round(coalesce(sum(1.5 * f), 0), 4) AS integral FROM m")
def integral_solid(spark, sf_dir):
    nodes, elements = boxes(spark, sf_dir)
    return M.integral(elements, nodes, nodes, "f", "inside").select(rounded(F.col("integral"), 4).alias("integral"))


#: In SQL: faces of the same hexahedra without a neighbour, with their area vectors.
SKIN = f"""WITH {BOXES}, d(face, step, nx, ny, nz) AS (VALUES (0, -25, 0.0, 0.0, -1.0), (1, 25, 0.0, 0.0, 1.0), (2, -5, 0.0, -1.5, 0.2), (3, 1, 1.5, -0.45, 0.06), (4, 5, 0.0, 1.5, -0.2), (5, -1, -1.5, 0.45, -0.06)),
f AS (SELECT e, face, nx::DOUBLE AS nx, ny::DOUBLE AS ny, nz::DOUBLE AS nz FROM o, d WHERE NOT EXISTS (SELECT 1 FROM o t WHERE t.e = o.e + step AND (abs(step) = 25 OR (abs(step) = 5 AND t.e // 25 = o.e // 25) OR (abs(step) = 1 AND t.e // 5 = o.e // 5))))"""


def skin(spark, sf_dir):
    nodes, elements = boxes(spark, sf_dir)
    return nodes, B.area_vectors(B.boundary_faces(elements), elements, nodes)


@query(f"{SKIN} SELECT e AS elem_id, face, nx, ny, nz FROM f")
def boundary_normals(spark, sf_dir):
    """Faces that bound a mesh of hexahedra, with their outward area vectors."""
    f = skin(spark, sf_dir)[1]
    return f.select("elem_id", "face", *((rounded(V.comp(F.col("normal"), k), 9) + 0.0).alias(c) for k, c in enumerate(("nx", "ny", "nz"))))


@query(f"WITH {BOXES} SELECT (4.5 * count(*))::DOUBLE AS flux, 0::DOUBLE AS leak FROM o")
def surface_flux(spark, sf_dir):
    """Places flow outwards through a closed surface as three times the volume within, and its area vectors add up to nothing."""
    nodes, f = skin(spark, sf_dir)
    leak = f.agg(sum((F.abs(F.sum(V.comp(F.col("normal"), k))) for k in range(3)), F.lit(0.0)).alias("leak"))
    return B.flux(f, nodes, list(COORDS)).crossJoin(leak).select(rounded("flux", 4).alias("flux"), (rounded("leak") + 0.0).alias("leak"))


@query(f"WITH {BOXES}, s AS (SELECT e, count(*) AS n FROM (SELECT o.e FROM o JOIN o t ON t.e IN (o.e - 25, o.e + 25) UNION ALL SELECT o.e FROM o JOIN o t ON t.e IN (o.e - 5, o.e + 5) AND t.e // 25 = o.e // 25 UNION ALL SELECT o.e FROM o JOIN o t ON t.e IN (o.e - 1, o.e + 1) AND t.e // 5 = o.e // 5) GROUP BY e) SELECT e AS elem_id, n AS sharing FROM s")
def face_neighbours(spark, sf_dir):
    return B.neighbours(boxes(spark, sf_dir)[1]).groupBy("elem_id").agg(F.count(F.lit(1)).alias("sharing"))


#: In SQL: places of customers in the lattice's own coordinates (a few outside), and in space.
PLACES = """q AS (SELECT c_custkey AS id, (c_custkey % 45) / 10.0 - 0.25 AS i, (c_custkey % 41) / 10.0 - 0.15 AS j, (c_custkey % 199) / 2.6 AS l FROM customer),
s AS (SELECT *, i + 0.3 * j AS x, j + 0.2 * l AS y, 1.5 * l AS z, floor(i)::BIGINT AS a, floor(j)::BIGINT AS b, floor(l)::BIGINT AS d FROM q)"""


def places(spark, sf_dir):
    k = F.col("c_custkey")
    i, j, l = (k % 45) / 10.0 - 0.25, (k % 41) / 10.0 - 0.15, (k % 199) / 2.6
    return table(spark, sf_dir, "customer").select(k.alias("id"), (i + 0.3 * j).alias("x"), (j + 0.2 * l).alias("y"), (1.5 * l).alias("z"))


@query(f"""WITH {BOXES}, {PLACES}, n AS (SELECT p_partkey::BIGINT AS node, p_partkey % 5 + 0.3 * (p_partkey // 5 % 5) AS x, p_partkey // 5 % 5 + 0.2 * (p_partkey // 25) AS y, 1.5 * (p_partkey // 25) AS z, p_retailprice AS f FROM part),
h AS (SELECT s.id, sum(CASE WHEN c.a = 1 THEN s.i - s.a ELSE 1 - s.i + s.a END * CASE WHEN c.b = 1 THEN s.j - s.b ELSE 1 - s.j + s.b END * CASE WHEN c.d = 1 THEN s.l - s.d ELSE 1 - s.l + s.d END * n.f) AS f
 FROM s JOIN c ON c.e = s.a + 5 * s.b + 25 * s.d AND s.a BETWEEN 0 AND 3 AND s.b BETWEEN 0 AND 3 JOIN n ON n.node = c.node GROUP BY s.id),
near AS (SELECT s.id, min_by(n.f, (round(pow(s.x - n.x, 2) + pow(s.y - n.y, 2) + pow(s.z - n.z, 2), 9), n.node)) AS f FROM s, n GROUP BY s.id)
SELECT near.id, round(coalesce(h.f, near.f), 6) AS f, h.f IS NOT NULL AS inside FROM near LEFT JOIN h ON h.id = near.id""")
def interpolation_solid(spark, sf_dir):
    """Prices at places among hexahedra by their shape functions; outside by the nearest node."""
    nodes, elements = boxes(spark, sf_dir)
    f = L.interpolated(places(spark, sf_dir), elements, nodes.select("node_id", *COORDS), nodes, ["f"])
    return f.select("id", rounded("f").alias("f"), F.col("elem_id").isNotNull().alias("inside"))


_V = ["v", "u / 100", "(v - 1)"]


@query(f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT event_type, {i + 3 * j} AS k, round(sum(dt * {a} * {b}) / max(t), 3) AS moment FROM e GROUP BY event_type" for j, b in enumerate(_V) for i, a in enumerate(_V)))
def ts_second_tensor(spark, sf_dir):
    v = [F.col("v"), F.col("u") / 100, F.col("v") - 1]
    m = events(spark, sf_dir).groupBy("event_type").agg(S.moment_tensor([v, v], "t").alias("m"))
    return m.select("event_type", F.posexplode("m").alias("k", "moment")).withColumn("moment", rounded(F.col("moment"), 3))


@query(f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT event_type, {i + 3 * j + 9 * k} AS k, round(sum(dt * {a} * {b} * {c}) / max(t), 1) AS moment FROM e GROUP BY event_type" for k, c in enumerate(_V) for j, b in enumerate(_V) for i, a in enumerate(_V)))
def ts_third_tensor(spark, sf_dir):
    v = [F.col("v"), F.col("u") / 100, F.col("v") - 1]
    m = events(spark, sf_dir).groupBy("event_type").agg(S.moment_tensor([v, v, v], "t").alias("m"))
    return m.select("event_type", F.posexplode("m").alias("k", "moment")).withColumn("moment", rounded(F.col("moment"), 1))


@query(f"""WITH {SERIES}, a AS (SELECT event_type, i, n, (1 - cos(2 * pi() * i / (n - 1))) / 2 AS w, v - avg(v) OVER (PARTITION BY event_type) AS v FROM s), b AS (SELECT event_type, sum(w * w) AS sww FROM a GROUP BY 1),
k AS (SELECT DISTINCT event_type, n, unnest(range(0, n // 4 + 1)) AS k FROM s), x AS (SELECT k.event_type, k.k, k.n, pow(sum(v * w * cos(2 * pi() * (k.k * i % k.n) / k.n)), 2) + pow(sum(v * w * sin(2 * pi() * (k.k * i % k.n) / k.n)), 2) AS p FROM a JOIN k ON a.event_type = k.event_type GROUP BY 1, 2, 3)
SELECT x.event_type, round(k / (n * 0.5), 9) AS freq, round(p * 0.5 / sww * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END, 3) AS power FROM x JOIN b ON x.event_type = b.event_type WHERE k / (n * 0.5) <= 0.5""")
def fft_spectra(spark, sf_dir):
    """Densities under a Hann window, up to half of the highest frequency."""
    x = G.fft_spectra(samples(spark, sf_dir), "event_type", "i", "v", 0.5, windowing=True, lowpass=0.5)
    return x.select("event_type", rounded(F.col("freq"), 9).alias("freq"), rounded(F.col("power"), 3).alias("power"))


@query("""WITH e AS (SELECT event_type, date_diff('microsecond', TIMESTAMP '2023-12-31', ts) / 1e6 AS t, value AS v FROM events WHERE value IS NOT NULL), m AS (SELECT event_type, min(t) AS t0, max(t) - min(t) AS w, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM e GROUP BY 1),
k AS (SELECT event_type, unnest(range(1, (n // 2) + 1)) AS k FROM m), x AS (SELECT e.event_type, k, n, var, 2 * pi() * k * (t - t0) / (2 * w) AS a, v - mean AS y FROM e JOIN m ON e.event_type = m.event_type JOIN k ON k.event_type = m.event_type),
s AS (SELECT event_type, k, atan2(sum(sin(2 * a)), sum(cos(2 * a))) / 2 AS p FROM x GROUP BY ALL)
SELECT x.event_type, x.k, round((pow(sum(y * cos(a - p)), 2) / sum(pow(cos(a - p), 2)) + pow(sum(y * sin(a - p)), 2) / sum(pow(sin(a - p), 2))) / (2 * any_value(var)), 5) AS power FROM x JOIN s ON x.event_type = s.event_type AND x.k = s.k GROUP BY 1, 2""")
def lomb_scargle_grid(spark, sf_dir):
    """Events by type, all of them, on the whole grid of frequencies twice as fine as the time they take, up to half of their mean rate."""
    e = table(spark, sf_dir, "events").select("event_type", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2023-12-31 00:00:00', cast(ts as timestamp_ntz))") / 1e6).alias("t"), "value")
    return G.lomb_grid(e, "event_type", "t", "value", ofac=2.0, hifac=0.5).select("event_type", "k", rounded(F.col("power"), 5).alias("power"))
