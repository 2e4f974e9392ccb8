"""Polygon, rotation, slicing, interpolation and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospan.operators import polygons as G
from aerospan.registry import SQL, query, rounded, table

#: A rectangle for each part: 0..size by 0..2 size, as vertices 0 to 3.
RECT = "r AS (SELECT p_partkey AS id, k AS pt_no, (CASE WHEN k IN (1, 2) THEN p_size ELSE 0 END)::DOUBLE AS x, (CASE WHEN k IN (2, 3) THEN 2 * p_size ELSE 0 END)::DOUBLE AS y FROM part, range(0, 4) t(k))"


def rectangles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pt_no"))
    return p.select("id", "pt_no", F.when(F.col("pt_no").isin(1, 2), F.col("p_size")).otherwise(0).cast("double").alias("x"), F.when(F.col("pt_no").isin(2, 3), 2 * F.col("p_size")).otherwise(0).cast("double").alias("y"))


@query("SELECT p_partkey AS id, 2.0 * p_size * p_size AS area, 6.0 * p_size AS outline FROM part")
def polygon_area(spark, sf_dir):
    return G.area(rectangles(spark, sf_dir))


@query(f"WITH {RECT} SELECT id, pt_no, x AS x0, y AS y0, lead(x, 1, 0.0) OVER (PARTITION BY id ORDER BY pt_no) AS x1, lead(y, 1, 0.0) OVER (PARTITION BY id ORDER BY pt_no) AS y1 FROM r")
def polygon_edges(spark, sf_dir):
    return G.edges(rectangles(spark, sf_dir))


@query("SELECT p_partkey AS id, 2 * greatest(1, ceil(p_size / 7.0)) + 2 * greatest(1, ceil(2 * p_size / 7.0)) AS points FROM part")
def shorten_edges(spark, sf_dir):
    return G.shortened(rectangles(spark, sf_dir), 7.0).groupBy("id").agg(F.count(F.lit(1)).alias("points"))


@query(f"WITH {RECT} SELECT id, pt_no, 2 * x - y + 1 AS x, x + 3 * y - 2 AS y FROM r")
def affine_polygon(spark, sf_dir):
    return G.transformed(rectangles(spark, sf_dir), 2.0, -1.0, 1.0, 3.0, 1.0, -2.0).select("id", "pt_no", "x", "y")


@query(f"WITH {RECT} SELECT id, pt_no, round(5 + cos(radians(30)) * (x - 5) - sin(radians(30)) * (y - 5), 6) AS x, round(5 + sin(radians(30)) * (x - 5) + cos(radians(30)) * (y - 5), 6) AS y FROM r")
def rotate_plane(spark, sf_dir):
    x, y = G.turned(F.col("x"), F.col("y"), 30.0, 5.0, 5.0)
    return rectangles(spark, sf_dir).select("id", "pt_no", rounded(x).alias("x"), rounded(y).alias("y"))


@query("SELECT vec_id, round(cos(radians(40)) * a - sin(radians(40)) * b, 6) AS x, round(sin(radians(40)) * a + cos(radians(40)) * b, 6) AS y, round(c, 6) AS z FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)")
def rodrigues(spark, sf_dir):
    p = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", G.about_axis(p, (0.0, 0.0, 1.0), 40.0).alias("p"))
    return e.select("vec_id", *(rounded(F.get("p", F.lit(k)) + 0.0).alias(c) for k, c in enumerate("xyz")))


@query("SELECT p_partkey AS id, 2.0 * p_size * p_size AS area FROM part")
def smallest_box(spark, sf_dir):
    """Of rectangles turned by their number of degrees."""
    r = rectangles(spark, sf_dir)
    c, s = F.cos(F.radians(F.col("id").cast("double"))), F.sin(F.radians(F.col("id").cast("double")))
    turned = r.select("id", "pt_no", (c * F.col("x") - s * F.col("y")).alias("x"), (s * F.col("x") + c * F.col("y")).alias("y"))
    return G.smallest_boxes(turned).select("id", rounded(F.col("area"), 5).alias("area"))


@query("SELECT a.p_partkey AS id, a.p_partkey + 1 AS other FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size >= 20")
def polygons_touching(spark, sf_dir):
    """Each rectangle and the next one moved 20 to the right and 1 up. Ids of moved rectangles are below zero, so that no number of parts reaches them."""
    r = rectangles(spark, sf_dir)
    moved = r.select((-F.col("id") - 1).alias("id"), "pt_no", (F.col("x") + 20).alias("x"), (F.col("y") + 1).alias("y"))
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (-F.col("p_partkey") - 2).alias("other"))
    return G.in_contact(r.unionByName(moved), pairs).select("id", (-F.col("other") - 1).alias("other"))


query(SQL["polygons_touching"], "polygons_touching_all")(polygons_touching)  # a second name


@query("SELECT a.p_partkey AS edge_id, round(a.p_partkey + (24.5 - a.p_size::DOUBLE) / (b.p_size - a.p_size), 6) AS x, a.p_retailprice AS y, 0.0::DOUBLE AS z FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE (a.p_size <= 24.5) <> (b.p_size <= 24.5)")
def contour_points(spark, sf_dir):
    """Where the size passes 24.5 between a part and the next one, on edges along x."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("v"))
    point = lambda d, v: F.struct((F.col("k") + float(d)).alias("x"), "y", F.lit(0.0).alias("z"), F.col(v).alias("v"))
    e = p.join(p.select((F.col("k") - 1).alias("k"), F.col("v").alias("w")), "k").select(F.col("k").alias("edge_id"), point(0, "v").alias("a"), point(1, "w").alias("b"))
    return G.plane_slice(e, 24.5).select("edge_id", rounded(F.col("x")).alias("x"), "y", "z")


@query("""WITH n AS (SELECT p_partkey AS k, p_partkey % 10 AS i, p_partkey // 10 AS j, p_retailprice AS f FROM part),
q AS (SELECT o_orderkey AS id, (o_orderkey % 40) * 0.26::DOUBLE + 0.01 AS x, (o_orderkey // 40) * 0.27::DOUBLE + 0.02 AS y FROM orders), c AS (SELECT *, floor(x)::BIGINT AS i, floor(y)::BIGINT AS j, x - floor(x) AS a, y - floor(y) AS b FROM q)
SELECT id, round(CASE WHEN a >= b THEN o.f + a * (r.f - o.f) + b * (d.f - r.f) ELSE o.f + a * (d.f - u.f) + b * (u.f - o.f) END, 6) AS v
FROM c JOIN n o ON o.i = c.i AND o.j = c.j AND o.i < 9 JOIN n r ON r.k = o.k + 1 JOIN n u ON u.k = o.k + 10 JOIN n d ON d.k = o.k + 11""")
def triangle_interpolation(spark, sf_dir):
    """Prices of parts on a lattice, ten a row, at places of orders: squares are cut into triangles, places beyond the lattice have no row."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("f"))
    for name, step in (("r", 1), ("u", 10), ("d", 11)):
        p = p.join(p.select((F.col("k") - step).alias("k"), F.col("f").alias(f"f{name}")), "k")
    i, j = (F.col("k") % 10).cast("double"), F.floor(F.col("k") / 10).cast("double")
    corner = {"f": (0, 0), "fr": (1, 0), "fd": (1, 1), "fu": (0, 1)}
    tri = lambda *c: F.struct(F.array(*(F.array(i + corner[n][0], j + corner[n][1]) for n in c)).alias("p"), F.array(*c).alias("f"))
    t = p.where(F.col("k") % 10 < 9).select("k", F.posexplode(F.array(tri("f", "fr", "fd"), tri("f", "fd", "fu"))).alias("half", "t")).select((2 * F.col("k") + F.col("half")).alias("tri_id"), "t.p", "t.f")
    o = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select(o.alias("id"), ((o % 40) * 0.26 + 0.01).alias("x"), (F.floor(o / 40) * 0.27 + 0.02).alias("y"))
    return G.interpolated(q, t, 1.0).select("id", rounded(F.col("v")).alias("v"))


@query("SELECT a.c_custkey AS id, b.c_custkey AS other FROM customer a JOIN customer b ON pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.c_nationkey - b.c_nationkey, 2) < 4")
def tolerance_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return G.matched(c, c, ["x", "y"], 2.0)


@query("SELECT count(*) - floor(count(*) * 0.37)::BIGINT AS kept FROM customer")
def thin_points(spark, sf_dir):
    return G.thinned(table(spark, sf_dir, "customer"), 37.0, "c_custkey").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def pair_combinations(spark, sf_dir):
    return G.combinations(table(spark, sf_dir, "nation"), "n_nationkey")


@query("SELECT vec_id, round(sqrt(10 * 0.01 * k / e), 6) AS taylor, round(pow(0.000001 / e, 0.25), 6) AS eta, round(sqrt(0.01 / e), 6) AS tau FROM (SELECT vec_id, 1 + abs(embedding[1]::DOUBLE) AS k, 0.5 + abs(embedding[2]::DOUBLE) AS e FROM embeddings)")
def turbulence_scales(spark, sf_dir):
    k, e = (c + F.abs(F.get("embedding", F.lit(n)).cast("double")) for n, c in ((0, 1.0), (1, 0.5)))
    return table(spark, sf_dir, "embeddings").select("vec_id", *(rounded(c).alias(n) for c, n in zip(G.small_scales(k, e, 0.01), ("taylor", "eta", "tau"), strict=True)))


@query("""WITH q AS (SELECT c_custkey AS id, c_custkey % 30 + 0.5::DOUBLE AS x, c_custkey // 30 + 0.5::DOUBLE AS y FROM customer)
SELECT id, tj * 3 + ti AS tile, 7 - floor(y - tj * 6)::BIGINT AS i, floor(x - ti * 6)::BIGINT AS j FROM (SELECT id, x, y, ti, t AS tj FROM (SELECT id, x, y, unnest([0, 1, 2]) AS ti FROM q), LATERAL (SELECT unnest([floor(y / 6)::BIGINT - 1, floor(y / 6)::BIGINT]) AS t)) WHERE tj >= 0 AND x - ti * 6 >= 0 AND x - ti * 6 < 8 AND y - tj * 6 >= 0 AND y - tj * 6 < 8""")
def point_tiles(spark, sf_dir):
    """Customers on a lattice, thirty a row, in overlapping tiles of eight points a side, three tiles across."""
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(k.alias("id"), ((k % 30) + 0.5).alias("x"), (F.floor(k / 30) + 0.5).alias("y"))
    return G.tiled(q, (0.0, 0.0), 6.0, 8, 1.0, 3).select("id", "tile", "i", "j")
