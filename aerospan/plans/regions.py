"""Queries of footprints, point clouds, clipped meshes and plain field operations, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospan.operators import boxtree as B
from aerospan.operators import regions as R
from aerospan.operators import spatial as X
from aerospan.operators import statistics as A
from aerospan.registry import query, rounded, table

#: In SQL: a cloud of customers, a rectangle for each nation, the corners of these.
CLOUD = "c AS (SELECT c_custkey AS id, (c_custkey % 2500) / 100.0::DOUBLE AS x, c_acctbal / 100 AS y, c_acctbal AS z FROM customer)"
FOOT = "f AS (SELECT n_nationkey::BIGINT AS poly, (n_nationkey % 5) * 5.0::DOUBLE AS x0, (n_nationkey % 5) * 5.0 + 4.0::DOUBLE AS x1, (n_nationkey // 5) * 20.0 - 10.0::DOUBLE AS y0, (n_nationkey // 5) * 20.0 + 6.0::DOUBLE AS y1 FROM nation)"
INSIDE = "i AS (SELECT c.*, poly FROM c JOIN f ON c.x >= x0 AND c.x < x1 AND c.y >= y0 AND c.y < y1)"
RING = "r AS (SELECT poly, pt_no, CASE WHEN pt_no IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN pt_no < 2 THEN y0 ELSE y1 END AS y FROM f, range(0, 4) t(pt_no))"


def cloud(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 2500) / 100.0).alias("x"), (F.col("c_acctbal") / 100).alias("y"), F.col("c_acctbal").alias("z"))


def rings(spark, sf_dir):
    k = F.col("n_nationkey")
    x0, y0 = (k % 5) * 5.0, F.floor(k / 5) * 20.0 - 10.0
    corners = F.array(*(F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in ((0.0, 0.0), (4.0, 0.0), (4.0, 16.0), (0.0, 16.0))))
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), F.posexplode(corners).alias("pt_no", "p")).select("id", "pt_no", "p.x", "p.y")


@query(f"WITH {CLOUD}, {FOOT}, {INSIDE} SELECT poly, count(*) AS n, round(quantile_cont(z, 0.7), 4) AS elevation, round(max(z) - min(z), 4) AS height, round(avg(z), 4) AS mean FROM i GROUP BY poly")
def ring_elevations(spark, sf_dir):
    e = R.ring_elevations(cloud(spark, sf_dir), rings(spark, sf_dir), 0.7)
    return e.select("poly", "n", *(rounded(F.col(c), 4).alias(c) for c in ("elevation", "height", "mean")))


@query(f"WITH {CLOUD}, {FOOT}, {INSIDE}, l AS (SELECT poly, quantile_cont(z, 0.25) AS lz FROM i GROUP BY poly) SELECT c.id, round(coalesce(lz, c.z), 4) AS z FROM c LEFT JOIN i ON i.id = c.id LEFT JOIN l ON l.poly = i.poly")
def flattened_points(spark, sf_dir):
    return R.flattened(cloud(spark, sf_dir), rings(spark, sf_dir), 0.25).select("id", rounded(F.col("z"), 4).alias("z"))


@query(f"WITH {CLOUD}, {FOOT}, {INSIDE} SELECT c.id, CASE WHEN poly IS NULL THEN NULL WHEN poly % 2 = 0 THEN 'building' ELSE 'terrain' END AS layer FROM c LEFT JOIN i ON i.id = c.id")
def layer_tags(spark, sf_dir):
    name = lambda p: F.when(p % 2 == 0, "building").when(p.isNotNull(), "terrain")
    return R.layered(cloud(spark, sf_dir), rings(spark, sf_dir), name)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS poly FROM part WHERE p_partkey % 3 < 2 AND p_size > 1 AND p_size < 49")
def ring_part_of(spark, sf_dir):
    """A small square for each part: in one of two large ones, across the edge of one, or outside."""
    p = table(spark, sf_dir, "part")
    x = (F.col("p_partkey") % 3) * 100.0 + 10.0 + F.when(F.col("p_partkey") % 3 == 2, 900.0).otherwise(0.0)
    square = lambda x, y, s: F.array(*(F.struct((x + a * s).alias("x"), (y + b * s).alias("y")) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))
    small = p.select(F.col("p_partkey").alias("id"), F.posexplode(square(x, F.col("p_size") - 0.5, 1.0)).alias("pt_no", "q")).select("id", "pt_no", "q.x", "q.y")
    large = spark.range(2).select("id", F.posexplode(square(F.col("id") * 100.0 + 0.0, F.lit(1.0), 47.9)).alias("pt_no", "q")).select((F.col("id") - 2).alias("id"), "pt_no", "q.x", "q.y")
    return R.part_of(small, large).select("id", (F.col("poly") + 2).alias("poly"))


@query("SELECT p_partkey AS id, round(greatest(p_size, 10) * greatest(p_size, 10), 6)::DOUBLE AS largest2 FROM part")
def ring_dimension(spark, sf_dir):
    s = F.col("p_size").cast("double")
    ring = F.array(*(F.struct((s * a).alias("x"), F.lit(10.0 * b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(ring).alias("pt_no", "p")).select("id", "pt_no", "p.x", "p.y")
    return R.dimension2(p).select("id", rounded(F.col("largest2")).alias("largest2"))


@query(f"WITH {FOOT}, {RING} SELECT poly AS id, bool_and(pow(x - 10, 2) + pow(y - 30, 2) <= 400) AS within FROM r GROUP BY poly HAVING bool_or(pow(x - 10, 2) + pow(y - 30, 2) <= 400)")
def influence_region(spark, sf_dir):
    return R.influence(rings(spark, sf_dir), 10.0, 30.0, 20.0)


@query(f"""WITH {CLOUD}, {FOOT}, {RING}, d AS (SELECT poly, pt_no, z, pow(c.x - r.x, 2) + pow(c.y - r.y, 2) AS d2, row_number() OVER (PARTITION BY poly, pt_no ORDER BY pow(c.x - r.x, 2) + pow(c.y - r.y, 2), id) AS k FROM c, r)
SELECT poly AS id, pt_no::INT AS pt_no, round(coalesce(max(CASE WHEN d2 = 0 THEN z END), sum(CASE WHEN d2 > 0 THEN z / d2 END) / sum(CASE WHEN d2 > 0 THEN 1 / d2 END)), 4) AS z FROM d WHERE k <= 3 GROUP BY 1, 2""")
def vertex_elevations(spark, sf_dir):
    return R.vertex_elevations(rings(spark, sf_dir), cloud(spark, sf_dir), 3, 2.0).select("id", "pt_no", rounded(F.col("z"), 4).alias("z"))


@query(f"WITH {CLOUD} SELECT id FROM c WHERE x BETWEEN 0.5 AND 15 AND y BETWEEN 0 AND 50.5 AND z BETWEEN 100 AND 4000")
def cloud_in_bounds(spark, sf_dir):
    return cloud(spark, sf_dir).where(R.in_box([F.col(c) for c in "xyz"], [0.5, 0.0, 100.0], [15.0, 50.5, 4000.0])).select("id")


@query(f"WITH {CLOUD}, s AS (SELECT s_suppkey AS query, (s_suppkey % 250) / 10.0::DOUBLE AS x, s_acctbal / 100 AS y FROM supplier) SELECT query, id, greatest(abs(c.x - s.x), abs(c.y - s.y)) <= 1.5 AS sure FROM c, s WHERE greatest(abs(c.x - s.x), abs(c.y - s.y)) <= 2.5")
def box_search_fuzzy(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), ((F.col("s_suppkey") % 250) / 10.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    return R.box_search(cloud(spark, sf_dir), s, ["x", "y"], 2.0, 0.5)


@query(f"""WITH {CLOUD}, s AS (SELECT s_suppkey AS query, (s_suppkey % 250) / 10.0::DOUBLE AS x, s_acctbal / 100 AS y FROM supplier), d AS (SELECT query, id, z, pow(c.x - s.x, 2) + pow(c.y - s.y, 2) AS d2, row_number() OVER (PARTITION BY query ORDER BY pow(c.x - s.x, 2) + pow(c.y - s.y, 2), id) AS k FROM c, s)
SELECT query, id AS primitive, round(sqrt(d2), 6) AS distance, z FROM d WHERE k = 1""")
def closest_primitive(spark, sf_dir):
    """The nearest point with what belongs to it; its distance is the least distance to the set."""
    c = cloud(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), ((F.col("s_suppkey") % 250) / 10.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    return X.nearest(c.select("id", "x", "y"), s, 1, ["x", "y"]).join(c.select("id", "z"), "id").select("query", F.col("id").alias("primitive"), rounded(F.sqrt("d2")).alias("distance"), "z")


#: In SQL: triangles, segments and points in space from parts (by number modulo 3), and the squared distance of suppliers to each.
SOLIDS = """t AS (SELECT p_partkey AS id, p_partkey % 3 + 1 AS n, (p_partkey % 97)::DOUBLE AS a1, (p_partkey % 89)::DOUBLE AS a2, (p_partkey % 31)::DOUBLE AS a3, p_size / 7.0 AS u, (p_partkey % 11) / 3.0 AS v FROM part),
c AS (SELECT id, n, a1, a2, a3, CASE WHEN n > 1 THEN a1 + u ELSE a1 END AS b1, CASE WHEN n > 1 THEN a2 + v ELSE a2 END AS b2, CASE WHEN n > 1 THEN a3 + 1 ELSE a3 END AS b3,
CASE WHEN n > 2 THEN a1 - v WHEN n > 1 THEN a1 + u ELSE a1 END AS c1, CASE WHEN n > 2 THEN a2 + u WHEN n > 1 THEN a2 + v ELSE a2 END AS c2, CASE WHEN n > 2 THEN a3 + 2 WHEN n > 1 THEN a3 + 1 ELSE a3 END AS c3 FROM t),
s AS (SELECT c_custkey AS query, (c_custkey % 101)::DOUBLE AS x, abs(c_acctbal) / 110 AS y, (c_custkey % 37)::DOUBLE AS z FROM customer),
e AS (SELECT *, b1 - a1 AS px, b2 - a2 AS py, b3 - a3 AS pz, c1 - a1 AS qx, c2 - a2 AS qy, c3 - a3 AS qz FROM c),
g AS (SELECT query, id, n, px, py, pz, qx, qy, qz, x - a1 AS wx, y - a2 AS wy, z - a3 AS wz, px * px + py * py + pz * pz AS pp, px * qx + py * qy + pz * qz AS pq, qx * qx + qy * qy + qz * qz AS qq FROM e, s),
h AS (SELECT *, wx * px + wy * py + wz * pz AS wp, wx * qx + wy * qy + wz * qz AS wq, pp * qq - pq * pq AS det FROM g),
k AS (SELECT *, CASE WHEN n > 2 THEN (qq * wp - pq * wq) / det END AS a, CASE WHEN n > 2 THEN (pp * wq - pq * wp) / det END AS b, CASE WHEN n > 1 THEN greatest(0, least(1, wp / pp)) ELSE 0 END AS t1,
CASE WHEN n > 2 THEN greatest(0, least(1, wq / qq)) ELSE 0 END AS t2, CASE WHEN n > 2 THEN greatest(0, least(1, (wq - wp - pq + pp) / (pp - 2 * pq + qq))) ELSE 0 END AS t3 FROM h),
d AS (SELECT query, id, n, CASE WHEN n > 2 AND a >= 0 AND b >= 0 AND a + b <= 1 THEN pow(wx - a * px - b * qx, 2) + pow(wy - a * py - b * qy, 2) + pow(wz - a * pz - b * qz, 2)
ELSE least(pow(wx - t1 * px, 2) + pow(wy - t1 * py, 2) + pow(wz - t1 * pz, 2), CASE WHEN n > 2 THEN pow(wx - t2 * qx, 2) + pow(wy - t2 * qy, 2) + pow(wz - t2 * qz, 2) END,
CASE WHEN n > 2 THEN pow(wx - px - t3 * (qx - px), 2) + pow(wy - py - t3 * (qy - py), 2) + pow(wz - pz - t3 * (qz - pz), 2) END) END AS d2 FROM k)"""


def primitives(spark, sf_dir):
    k = F.col("p_partkey")
    u, v = F.col("p_size") / 7.0, (k % 11) / 3.0
    a = [(k % m).cast("double") for m in (97, 89, 31)]
    corners = [a, [a[0] + u, a[1] + v, a[2] + 1], [a[0] - v, a[1] + u, a[2] + 2]]
    return table(spark, sf_dir, "part").select(k.alias("id"), F.slice(F.array(*(F.array(*c) for c in corners)), F.lit(1), (k % 3 + 1).cast("int")).alias("p"))


def places(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("query"), (k % 101).cast("double").alias("x"), (F.abs("c_acctbal") / 110).alias("y"), (k % 37).cast("double").alias("z"))


@query(f"WITH {SOLIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(d2, 9), id) AS place FROM d) SELECT query, round(sqrt(d2), 6) AS distance, place FROM r WHERE place <= 3")
def closest_in_space(spark, sf_dir):
    """The three nearest of triangles, segments and points in space."""
    r = B.nearest_primitives(primitives(spark, sf_dir), places(spark, sf_dir), 3)
    return r.select("query", rounded(F.sqrt("d2")).alias("distance"), "place")


@query(f"WITH {SOLIDS} SELECT query, CASE min_by(n, (round(d2, 9), id)) WHEN 3 THEN 'triangle' WHEN 2 THEN 'segment' ELSE 'point' END AS kind, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY query")
def closest_kind(spark, sf_dir):
    r = B.nearest_primitives(primitives(spark, sf_dir), places(spark, sf_dir), 1)
    return r.select("query", "kind", rounded(F.sqrt("d2")).alias("distance"))


@query("""WITH b AS (SELECT p_partkey AS id, (p_partkey * 7 % 400)::DOUBLE AS x, (p_partkey * 13 % 90)::DOUBLE AS y, p_size::DOUBLE AS s FROM part), q AS (SELECT s_suppkey AS query, (s_suppkey * 11 % 400)::DOUBLE AS x, s_acctbal / 100 AS y FROM supplier),
e AS (SELECT query, b.id, greatest(abs(q.x - b.x - s / 2) - s / 2, 0) AS ox, greatest(abs(q.y - b.y - s / 2) - s / 2, 0) AS oy, s / 2 - greatest(abs(q.x - b.x - s / 2), abs(q.y - b.y - s / 2)) AS within FROM b, q)
SELECT query, round(min(CASE WHEN within >= 0 THEN within ELSE sqrt(ox * ox + oy * oy) END), 6) AS distance FROM e GROUP BY query""")
def perimeter_distance(spark, sf_dir):
    """Least distance to the outlines of squares, from inside or outside."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y = (k * 7 % 400).cast("double"), (k * 13 % 90).cast("double")
    corners = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))))
    rings = table(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(corners).alias("pt_no", "_p")).select("id", "pt_no", "_p.*")
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), (F.col("s_suppkey") * 11 % 400).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    return B.perimeter_distance(rings, p).select("query", rounded("distance").alias("distance"))


@query(f"""WITH {CLOUD}, s AS (SELECT s_suppkey AS query FROM supplier) SELECT query, k AS place, true AS near_enough FROM s, range(1, 6) t(k)""")
def knn_within_factor(spark, sf_dir):
    """Five neighbours within 1.5 times the distance of the true ones, held against an exact search."""
    c = cloud(spark, sf_dir).select("id", "x", "y")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), ((F.col("s_suppkey") % 250) / 10.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    exact = X.nearest(c, s, 5, ["x", "y"]).select("query", "place", F.col("d2").alias("best"))
    return X.nearest(c, s, 5, ["x", "y"], eps=0.5).join(exact, ["query", "place"]).select("query", "place", (F.col("d2") <= 1.5**2 * F.col("best") + 1e-12).alias("near_enough"))


#: In SQL: elements of three nodes from orders, over nodes from customers.
ELEMENTS = "e AS (SELECT o_orderkey AS elem_id, o_totalprice AS v, unnest([o_custkey, o_custkey + 1, o_custkey + 2]) AS node_id FROM orders)"


def elements(spark, sf_dir):
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("elem_id"), F.array(k, k + 1, k + 2).alias("nodes"), F.col("o_totalprice").alias("v"))


@query(f"WITH {CLOUD}, {ELEMENTS} SELECT elem_id FROM e JOIN c ON c.id = e.node_id WHERE x BETWEEN 0 AND 12 AND y >= 0 GROUP BY elem_id HAVING count(*) = 3")
def mesh_clip(spark, sf_dir):
    nodes = cloud(spark, sf_dir).withColumnRenamed("id", "node_id")
    return R.clipped(elements(spark, sf_dir), nodes, F.col("x").between(0, 12) & (F.col("y") >= 0)).select("elem_id")


@query(f"WITH {ELEMENTS} SELECT node_id, round(avg(v) + 1e-7, 4) AS v FROM e GROUP BY node_id")
def cell_to_point(spark, sf_dir):
    return R.cell_to_point(elements(spark, sf_dir), "v").select("node_id", rounded(F.col("v") + 1e-7, 4).alias("v"))  # means of cents end in ties


@query("""WITH e AS (SELECT l_orderkey AS elem_id, list(l_partkey ORDER BY l_partkey) AS nodes FROM lineitem GROUP BY 1), m AS (SELECT max(len(nodes)) AS m FROM e)
SELECT elem_id, m::INT AS size, array_to_string(list_resize(nodes, m, 0), ' ') AS nodes FROM e, m""")
def padded_connectivity(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("elem_id")).agg(F.sort_array(F.collect_list("l_partkey")).alias("nodes"))
    return R.padded(l).select("elem_id", F.size("nodes").alias("size"), F.array_join(F.col("nodes").cast("array<string>"), " ").alias("nodes"))


@query("SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, round(quantile_cont(c_acctbal, 0.1), 4) AS p10, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def elevation_percentiles(spark, sf_dir):
    p = table(spark, sf_dir, "customer").groupBy("c_nationkey")
    return p.agg(rounded(F.percentile("c_acctbal", 0.9), 4).alias("p90"), rounded(F.percentile("c_acctbal", 0.1), 4).alias("p10"), rounded(F.avg("c_acctbal"), 4).alias("mean"))


@query("SELECT c_custkey, concat_ws(' ', c_nationkey::VARCHAR, round(c_acctbal)::BIGINT::VARCHAR) AS key, min(c_custkey) OVER (PARTITION BY c_nationkey, round(c_acctbal)) AS vertex FROM customer")
def point_keys(spark, sf_dir):
    """Keys of points by their rounded place, and the first point with each key."""
    key = F.concat_ws(" ", "c_nationkey", F.round("c_acctbal").cast("long"))
    c = table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))
    first = c.groupBy("key").agg(F.min("c_custkey").alias("vertex"))
    return c.join(first, "key").select("c_custkey", "key", "vertex")


@query("SELECT c_custkey AS id, round(c_acctbal * 2 + 1, 4) AS pressure, c_nationkey AS zone FROM customer WHERE c_mktsegment <> 'BUILDING'")
def field_columns(spark, sf_dir):
    """A variable set from another, one renamed, the rest left out, and only rows that are active."""
    c = table(spark, sf_dir, "customer").withColumn("pressure", rounded(F.col("c_acctbal") * 2 + 1, 4)).where("c_mktsegment <> 'BUILDING'")
    return c.withColumnRenamed("c_nationkey", "zone").withColumnRenamed("c_custkey", "id").drop("c_name", "c_acctbal", "c_mktsegment")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_custkey, o_orderkey) - 1 AS place FROM orders")
def lexicographic_places(spark, sf_dir):
    """Places of orders in lexicographic order of priority, customer and number."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return A.in_places(o, *map(F.col, ("o_orderpriority", "o_custkey", "o_orderkey"))).select("o_orderkey", (F.col("place") - 1).alias("place"))


@query("SELECT l_partkey AS node_id, round(sum(l_quantity), 4) AS total, count(DISTINCT l_suppkey % 4) AS parts FROM lineitem GROUP BY 1")
def halo_sum(spark, sf_dir):
    """What parts of a mesh add up to at nodes they share: one grouped sum, combined before the shuffle."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_partkey").alias("node_id")).agg(rounded(F.sum("l_quantity"), 4).alias("total"), F.countDistinct(F.col("l_suppkey") % 4).alias("parts"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey JOIN nation c ON b.n_nationkey < c.n_nationkey AND b.n_regionkey = c.n_regionkey")
def triple_combinations(spark, sf_dir):
    """Combinations of three, within each region."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    a, b, c = (n.withColumnRenamed("n_nationkey", k) for k in "abc")
    return a.join(b, "n_regionkey").where("a < b").join(c, "n_regionkey").where("b < c").select("a", "b", "c")
