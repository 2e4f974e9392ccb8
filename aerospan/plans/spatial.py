"""Spatial joins, point features, tiles and spectra over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospan.functions import numeric as N
from aerospan.operators import polygons as O
from aerospan.operators import signals as G
from aerospan.operators import spatial as X
from aerospan.operators import tiles as T
from aerospan.registry import SQL, query, rounded, table

BOX_SQL = "b AS (SELECT p_partkey AS id, p_size::DOUBLE AS x_lo, p_size + 2.0 AS x_hi, p_retailprice AS y_lo, p_retailprice + 5.0 AS y_hi FROM part)"


def boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x_lo"), (F.col("p_size") + 2.0).alias("x_hi"), F.col("p_retailprice").alias("y_lo"), (F.col("p_retailprice") + 5.0).alias("y_hi"))


@query(f"WITH {BOX_SQL} SELECT a.id, b.id AS other FROM b a JOIN b ON a.x_lo <= b.x_hi AND b.x_lo <= a.x_hi AND a.y_lo <= b.y_hi AND b.y_lo <= a.y_hi")
def box_overlap_closed(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return X.box_join(b, b, ["x", "y"], [4.0, 10.0])


@query(f"WITH {BOX_SQL} SELECT a.id, b.id AS other FROM b a JOIN b ON a.x_lo < b.x_hi AND b.x_lo < a.x_hi AND a.y_lo < b.y_hi AND b.y_lo < a.y_hi")
def box_overlap_half_open(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return X.box_join(b, b, ["x", "y"], [4.0, 10.0], closed=False)


@query(f"WITH {BOX_SQL} SELECT a.id, b.id AS other, greatest(a.x_lo, b.x_lo) AS lo, least(a.x_hi, b.x_hi) AS hi FROM b a JOIN b ON b.id = a.id + 1 WHERE greatest(a.x_lo, b.x_lo) <= least(a.x_hi, b.x_hi)")
def box_intersection(spark, sf_dir):
    return next_box(boxes(spark, sf_dir))


def next_box(a):
    b = a.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("x_lo").alias("lo2"), F.col("x_hi").alias("hi2"))
    low, high = X.box_overlap((F.col("x_lo"), F.col("x_hi")), (F.col("lo2"), F.col("hi2")))
    return a.join(b, "id").select("id", "other", low.alias("lo"), high.alias("hi")).where("lo is not null")


@query("SELECT o_orderkey AS probe, p_partkey AS id FROM orders JOIN part ON o_totalprice > p_retailprice * 100 AND o_totalprice <= p_retailprice * 100 + p_size * 10")
def interval_stab(spark, sf_dir):
    return stabbed(table(spark, sf_dir, "part"), table(spark, sf_dir, "orders"))


def stabbed(p, orders):
    i = p.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + F.col("p_size") * 10).alias("hi"), F.lit(False).alias("lc"), F.lit(True).alias("rc"))
    return X.stab(i, orders.select(F.col("o_orderkey").alias("probe"), F.col("o_totalprice").alias("v")), 300.0)


for whole in (box_overlap_closed, box_overlap_half_open, box_intersection, interval_stab):  # a second name of each
    query(SQL[whole.__name__], f"{whole.__name__}_all")(whole)


def balances(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"), F.col("c_custkey").cast("double").alias("z"))


BAL = "c AS (SELECT c_custkey AS id, c_nationkey::DOUBLE AS x, c_acctbal / 100 AS y, c_custkey::DOUBLE AS z FROM customer)"
SUP = "s AS (SELECT s_suppkey AS query, s_nationkey::DOUBLE AS x, s_acctbal / 100 AS y FROM supplier)"


def suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))


@query(f"WITH {BAL}, {SUP} SELECT query, id, round(pow(c.x - s.x, 2) + pow(c.y - s.y, 2), 6) AS d2 FROM c, s WHERE pow(c.x - s.x, 2) + pow(c.y - s.y, 2) <= 25")
def range_points(spark, sf_dir):
    return X.range_join(balances(spark, sf_dir), suppliers(spark, sf_dir), 5.0, ["x", "y"], 6)


@query(f"WITH {BAL}, {SUP}, d AS (SELECT query, id, pow(c.x - s.x, 2) + pow(c.y - s.y, 2) AS d2 FROM c, s), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id) AS place FROM d) SELECT query, id, round(d2, 6) AS d2, place FROM r WHERE place <= 4")
def knn_grid(spark, sf_dir):
    return X.nearest(balances(spark, sf_dir), suppliers(spark, sf_dir), 4, ["x", "y"]).select("query", "id", rounded(F.col("d2")).alias("d2"), "place")


@query(f"WITH {BAL}, {SUP}, d AS (SELECT query, id, pow(c.x - s.x, 2) + pow(c.y - s.y, 2) AS d2 FROM c, s), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2 DESC, id) AS place FROM d) SELECT query, id, round(d2, 6) AS d2, place FROM r WHERE place <= 2")
def knn_furthest(spark, sf_dir):
    return X.nearest(balances(spark, sf_dir), suppliers(spark, sf_dir), 2, ["x", "y"], furthest=True).select("query", "id", rounded(F.col("d2")).alias("d2"), "place")


VEC = "SELECT a.vec_id AS query, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda k: pow(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE, 2))) AS d2 FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"


def dense(spark, sf_dir, k: int):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return X.nearest_dense(e, e.where("id % 50 = 0").withColumnRenamed("id", "query"), k, "v").select("query", "id", rounded(F.col("d2")).alias("d2"), "place")


@query(f"WITH d AS ({VEC}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id) AS place FROM d) SELECT query, id, round(d2, 6) AS d2, place FROM r WHERE place <= 1")
def nn1(spark, sf_dir):
    return dense(spark, sf_dir, 1)


@query(f"WITH d AS ({VEC}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id) AS place FROM d) SELECT query, id, round(d2, 6) AS d2, place FROM r WHERE place <= 5")
def knn5(spark, sf_dir):
    return dense(spark, sf_dir, 5)


TRI = "t AS (SELECT p_partkey AS tri_id, (p_partkey % 10) * 2.0::DOUBLE AS x, (p_partkey // 10) * 2.0::DOUBLE AS y, 5.0 + p_size AS z FROM part), q AS (SELECT o_orderkey AS id, (o_orderkey % 50) * 0.45::DOUBLE AS x, (o_orderkey // 50) * 0.45::DOUBLE AS y FROM orders)"
#: Right triangles of side 2: a point is inside where both offsets are at least 0 and sum to at most 2 (areas agree to 1e-3).
HIT = f"{TRI}, h AS (SELECT id, min(tri_id) AS tri_id FROM q JOIN t ON abs((abs((q.x - t.x) * 2) + abs((q.y - t.y) * 2) + abs(4 - 2 * (q.x - t.x) - 2 * (q.y - t.y))) / 2 - 2) < 0.001 GROUP BY id)"


def triangles(spark, sf_dir):
    """A triangle for each part on a lattice, ten a row, as high as the part's size and 5."""
    k = F.col("p_partkey")
    x, y, z = (k % 10) * 2.0, F.floor(k / 10) * 2.0, F.col("p_size") + 5.0
    return table(spark, sf_dir, "part").select(k.alias("tri_id"), F.array(F.array(x, y, z), F.array(x + 2.0, y, z), F.array(x, y + 2.0, z)).alias("p"))


def grid(spark, sf_dir):
    """Orders on a lattice, fifty a row."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), ((k % 50) * 0.45).alias("x"), (F.floor(k / 50) * 0.45).alias("y"))


@query(f"WITH {HIT} SELECT q.id, coalesce(h.tri_id, -1) AS tri_id FROM q LEFT JOIN h USING (id)")
def point_in_triangle(spark, sf_dir):
    return X.first_triangle(grid(spark, sf_dir), triangles(spark, sf_dir), 2.0)


@query(f"WITH {HIT} SELECT q.id, CASE WHEN h.tri_id IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS mask, coalesce(t.z, 0.0)::DOUBLE AS height FROM q LEFT JOIN h USING (id) LEFT JOIN t USING (tri_id)")
def node_features(spark, sf_dir):
    return X.node_features(grid(spark, sf_dir), triangles(spark, sf_dir), 2.0)


@query("SELECT p_partkey AS tri_id, p_size % 3 = 1 AS flat, p_size % 3 = 2 AS upright FROM part")
def triangle_filters(spark, sf_dir):
    """A triangle for each part: sloping, flat or upright by its size."""
    k = F.col("p_size") % 3
    h = F.when(k == 0, F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))).when(k == 1, F.array(F.lit(3.0), F.lit(3.0), F.lit(3.0))).otherwise(F.array(F.lit(0.0), F.lit(4.0), F.lit(0.0)))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tri_id"), F.transform(h, lambda z: F.array(F.lit(0.0), F.lit(0.0), z)).alias("p"))
    flat, up = X.horizontal(t).select("tri_id", F.lit(True).alias("flat")), X.vertical(t).select("tri_id", F.lit(True).alias("upright"))
    j = t.select("tri_id").join(flat, "tri_id", "left").join(up, "tri_id", "left")
    return j.select("tri_id", F.coalesce("flat", F.lit(False)).alias("flat"), F.coalesce("upright", F.lit(False)).alias("upright"))


@query("""WITH q AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 20011) / 100.0::DOUBLE + 0.003 AS x, (o_orderkey * 91 % 10007) / 100.0::DOUBLE + (o_orderkey // 10007) * 100 + 0.0047 AS y FROM orders),
c AS (SELECT id, floor(x / 10)::BIGINT + 20 * floor(y / 10)::BIGINT AS poly, x - 10 * floor(x / 10) AS x, y - 10 * floor(y / 10) AS y FROM q WHERE x < 200)
SELECT id, poly FROM c JOIN part ON p_partkey = poly WHERE x > 1 AND x < 9 AND y > 1 AND y < 9 AND NOT (x > 3 AND x < 4 + p_size / 25.0::DOUBLE AND y > 3 AND y < 4 + p_size / 25.0::DOUBLE)""")
def points_in_polygons(spark, sf_dir):
    """Orders in squares, one for each part, twenty a row, each with a hole as large as the part."""
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    low, high = F.lit(3.0), F.col("p_size") / 25.0 + 4.0
    ring = lambda a, b: [((a, a), (b, a)), ((b, a), (b, b)), ((b, b), (a, b)), ((a, b), (a, a))]
    sides = F.array(*(F.struct(p[0].alias("x0"), p[1].alias("y0"), q[0].alias("x1"), q[1].alias("y1")) for p, q in ring(F.lit(1.0), F.lit(9.0)) + ring(low, high)))
    left, down = (k % 20) * 10, F.floor(k / 20) * 10
    e = table(spark, sf_dir, "part").select(k.alias("poly"), left.alias("l"), down.alias("d"), F.explode(sides).alias("s"))
    e = e.select("poly", *((F.col(f"s.{c}") + F.col("l" if c[0] == "x" else "d")).alias(c) for c in ("x0", "y0", "x1", "y1")))
    points = table(spark, sf_dir, "orders").select(o.alias("id"), ((o * 37 % 20011) / 100.0 + 0.003).alias("x"), ((o * 91 % 10007) / 100.0 + F.floor(o / 10007) * 100 + 0.0047).alias("y"))
    return X.in_polygon(points, e)


@query(f"WITH {BAL} SELECT id, round(z - min(z) OVER w, 4) AS above, round(max(z) OVER w - z, 4) AS below, round(max(z) OVER w - min(z) OVER w, 4) AS span FROM c WINDOW w AS (PARTITION BY floor(x / 5), floor(y / 5))")
def grid_height(spark, sf_dir):
    return X.height_features(balances(spark, sf_dir), 5.0).select("id", *(rounded(F.col(c), 4).alias(c) for c in ("above", "below", "span")))


@query(f"""WITH {BAL}, g AS (SELECT floor(x / 5)::BIGINT AS i, floor(y / 5)::BIGINT AS j, count(*) AS n, sum(CASE WHEN id % 4 + 1 > 1 THEN 1 ELSE 0 END) AS m FROM c GROUP BY 1, 2)
SELECT a.i, a.j, round(sum(b.m) / sum(b.n)::DOUBLE, 6) AS scatter FROM g a JOIN g b ON abs(a.i - b.i) + abs(a.j - b.j) <= 1 GROUP BY 1, 2""")
def echo_scatter(spark, sf_dir):
    p = balances(spark, sf_dir).withColumn("echo", F.col("id") % 4 + 1)
    return X.echo_scatter(p, 5.0).select("i", "j", rounded(F.col("scatter")).alias("scatter"))


@query(f"WITH {BAL} SELECT a.id, round(coalesce(a.z - avg(b.z), 0.0), 4) AS gradient FROM c a LEFT JOIN c b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1 GROUP BY a.id, a.z")
def neighbour_gradient(spark, sf_dir):
    return X.radius_gradient(balances(spark, sf_dir), 1.0, ["x", "y"], "z").select("id", rounded(F.col("gradient"), 4).alias("gradient"))


@query("SELECT c_nationkey AS cluster, count(*) AS size, round(avg(c_acctbal), 4) AS mean, round(max(c_acctbal) - min(c_acctbal), 4) AS extent FROM customer GROUP BY 1")
def cluster_features(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cluster"))
    return c.agg(F.count(F.lit(1)).alias("size"), rounded(F.avg("c_acctbal"), 4).alias("mean"), rounded(F.max("c_acctbal") - F.min("c_acctbal"), 4).alias("extent"))


@query("SELECT c_nationkey AS cluster, max_by(c_custkey, c_acctbal) AS north, min_by(c_custkey, c_acctbal) AS south, min(c_custkey) AS west, max(c_custkey) AS east FROM customer GROUP BY 1")
def extreme_points(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("y"))
    e = X.extremes(p, ["cluster"])
    return e.select("cluster", *(F.col(f"{c}.x").alias(n) for c, n in (("n", "north"), ("s", "south"), ("w", "west"), ("e", "east"))))


@query()
def convex_hull(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return X.hulls(c)


#: A square, a dart, a star that turns left everywhere but goes round twice, a triangle that turns right.
SHAPES = (
    ((0, 0), (2, 0), (2, 2), (0, 2)),
    ((0, 0), (2, 0), (0.5, 0.5), (0, 2)),
    ((1, 0), (-0.81, 0.59), (0.31, -0.95), (0.31, 0.95), (-0.81, -0.59)),
    ((0, 0), (0, 3), (3, 0)),
)


@query("SELECT p_partkey AS id, p_partkey % 4 IN (0, 3) AS convex FROM part")
def convexity(spark, sf_dir):
    """Of a ring for each part: one of four shapes, at the part's size."""
    ring = F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in shape)) for shape in SHAPES))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", F.posexplode(F.get(ring, (F.col("p_partkey") % 4).cast("int"))).alias("pt_no", "p"))
    return X.convex(p.select("id", "pt_no", (F.col("p.x") * F.col("p_size")).alias("x"), (F.col("p.y") * F.col("p_size")).alias("y")))


@query("SELECT id, (floor(x / 32 * 2)::INT % 2 + 2 * (floor(y / 128 * 4 * 2)::INT % 2))::VARCHAR AS path FROM (SELECT c_custkey AS id, c_nationkey::DOUBLE AS x, (c_acctbal + 1000) / 400 * 4 / 4.0 AS y FROM customer)")
def quadtree_cell(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), ((F.col("c_acctbal") + 1000) / 400).alias("y"))
    return X.quadtree(c, 1, 32.0)


@query()
def quadtree_leaves(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), ((F.col("c_acctbal") + 1000) / 400).alias("y"))
    return X.leaves(X.quadtree(c, 6, 32.0), 50)


#: Parts as pixels of tiles of four a side, three tiles across; in SQL also the height of the whole field.
TILES = "m AS (SELECT 2 + 2 * (((count(*) + 15) // 16 + 2) // 3) AS h FROM part), t AS (SELECT p_partkey // 16 AS tile, p_partkey // 4 % 4 AS i, p_partkey % 4 AS j, p_retailprice AS v FROM part)"
W = "CASE {} WHEN 0 THEN 1.0 ELSE exp(-1.5) END".format
BLEND = f"""{TILES}, h AS (SELECT t.tile, t.i, t.j, CASE WHEN t.tile % 3 > 0 AND t.j < 2 THEN t.v * (1 - {W('t.j')}) + l.v * {W('t.j')} ELSE t.v END AS v FROM t LEFT JOIN t l ON l.tile = t.tile - 1 AND l.i = t.i AND l.j = t.j + 2),
u AS (SELECT h.tile, h.i, h.j, CASE WHEN b.v IS NOT NULL THEN h.v * {W('(h.i - 2)')} + b.v * (1 - {W('(h.i - 2)')}) ELSE h.v END AS v FROM h LEFT JOIN h b ON b.tile = h.tile - 3 AND b.i = h.i - 2 AND b.j = h.j AND h.i >= 2),
p AS (SELECT tile, m.h - 4 - (tile // 3) * 2 + i AS row, (tile % 3) * 2 + j AS col, v FROM u, m), g AS (SELECT r AS row, c AS col FROM m, unnest(range(0, h)) a(r), range(0, 10) b(c)),
f AS (SELECT g.row, g.col, coalesce(m.v, 0.0) AS v FROM g LEFT JOIN (SELECT row, col, max_by(v, tile) AS v FROM p GROUP BY 1, 2) m ON m.row = g.row AND m.col = g.col)"""


def tile_field(spark, sf_dir):
    """The blended field, and its number of rows."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    t = p.select(F.floor(k / 16).alias("tile"), (F.floor(k / 4) % 4).alias("i"), (k % 4).alias("j"), F.col("p_retailprice").alias("v"))
    height = 2 + 2 * (((p.count() + 15) // 16 + 2) // 3)
    return T.blend(t, 4, 2, 2, height, 3, 1.5, 1.5), height


@query(f"WITH {BLEND} SELECT row, col, round(v, 6) AS v FROM f")
def tile_blend(spark, sf_dir):
    return tile_field(spark, sf_dir)[0].select("row", "col", rounded(F.col("v")).alias("v"))


@query(f"WITH {BLEND}, b AS (SELECT min(c_acctbal) AS x0, max(c_acctbal) AS x1, min(c_nationkey)::DOUBLE AS y0, max(c_nationkey)::DOUBLE AS y1 FROM customer) SELECT row, col, round(x0 + (x1 - x0) * col / 9, 5) AS real_x, round(y0 + (y1 - y0) * row / (h - 1), 5) AS real_y, round(sqrt(v * v + 1), 6) AS wind_value, round(atan2(1.0, v), 6) AS dir FROM f, b, m")
def geolocate(spark, sf_dir):
    """The blended field spread over the range of the customers."""
    u, height = tile_field(spark, sf_dir)
    w = T.wind_table(u, u.withColumn("v", F.lit(1.0)))
    x, y = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    bounds = table(spark, sf_dir, "customer").agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))
    g = T.geolocate(w, height, 10, bounds)
    return g.select("row", "col", *(rounded(F.col(c), d).alias(c) for c, d in (("real_x", 5), ("real_y", 5), ("wind_value", 6), ("dir", 6))))


@query("SELECT name, key, row_number() OVER (ORDER BY key NULLS LAST, name) AS place FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'mask.csv' || p_partkey ELSE 'UGT-' || p_partkey * p_size || '-' || p_partkey || '.csv' END AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey * p_size END AS key FROM part)")
def files_by_number(spark, sf_dir):
    """File names, one for each part, some without a number and some with equal ones."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("mask.csv"), k)).otherwise(F.concat(F.lit("UGT-"), k * F.col("p_size"), F.lit("-"), k, F.lit(".csv")))
    return T.by_number(table(spark, sf_dir, "part").select(name.alias("name")), "name")


SERIES = "s AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS t FROM events)"


def samples(spark, sf_dir):
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 3.6e9")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("value").alias("v"), t.alias("t"))
    return G.numbered(e, "event_type", ["ts", "event_id"], "t")


@query(f"WITH {SERIES}, k AS (SELECT DISTINCT event_type, n, unnest(range(0, n // 2 + 1)) AS k FROM s) SELECT k.event_type, k.k, round((pow(sum(v * cos(2 * pi() * (k.k * i % k.n) / k.n)), 2) + pow(sum(v * sin(2 * pi() * (k.k * i % k.n) / k.n)), 2)) / k.n, 3) AS power FROM s JOIN k ON s.event_type = k.event_type GROUP BY k.event_type, k.k, k.n")
def periodogram(spark, sf_dir):
    """Of all samples of each event type."""
    return G.whole_periodogram(samples(spark, sf_dir), "event_type", "i", "v").select("event_type", "k", rounded(F.col("power"), 3).alias("power"))


@query(f"""WITH {SERIES}, f(freq) AS (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.3)), m AS (SELECT event_type, avg(v) AS m, var_samp(v) AS vr FROM s GROUP BY 1), y AS (SELECT s.event_type, freq, v - m AS y, vr, 2 * pi() * freq * t AS a FROM s JOIN m USING (event_type), f),
h AS (SELECT event_type, freq, atan2(sum(sin(2 * a)), sum(cos(2 * a))) / 2 AS sh FROM y GROUP BY 1, 2)
SELECT y.event_type, y.freq, round((pow(sum(y * cos(a - sh)), 2) / sum(pow(cos(a - sh), 2)) + pow(sum(y * sin(a - sh)), 2) / sum(pow(sin(a - sh), 2))) / 2 / max(vr), 5) AS power FROM y JOIN h ON y.event_type = h.event_type AND y.freq = h.freq GROUP BY 1, 2""")
def lomb_scargle(spark, sf_dir):
    return G.lomb_scargle(samples(spark, sf_dir), "event_type", "t", "v", [0.01, 0.05, 0.1, 0.3]).select("event_type", "freq", rounded(F.col("power"), 5).alias("power"))


for whole in (periodogram, lomb_scargle):  # a second name of each
    query(SQL[whole.__name__], f"{whole.__name__}_all")(whole)


@query()
def welch(spark, sf_dir):
    return G.welch(samples(spark, sf_dir), "event_type", "i", "v", 64, 32).select("event_type", "k", rounded(F.col("power"), 3).alias("power"))


@query("SELECT ceil(log2(f) * 2 - 0.5)::BIGINT AS band, round(avg(p), 5) AS power FROM (SELECT c_custkey + 1.0::DOUBLE AS f, c_acctbal AS p FROM customer) WHERE ceil(log2(f) * 2 - 0.5) < 80 GROUP BY 1")
def octave_bands(spark, sf_dir):
    """Balances of customers as powers at their numbers."""
    s = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1.0).alias("f"), F.col("c_acctbal").alias("p"))
    return G.octaves(s, "f", "p", 1.0, 2.0**40).select("band", rounded(F.col("power"), 5).alias("power"))


@query("SELECT p_partkey AS id, k::INT AS pt_no, round(p_partkey + p_size * cos(2 * pi() * k / 12), 6) AS x, round(20 + 0.5 * p_size * sin(2 * pi() * k / 12), 6) AS y FROM part, range(0, 12) t(k)")
def round_polygon(spark, sf_dir):
    """Ellipses around parts, twice as wide as high."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("double").alias("x"), F.lit(20.0).alias("y"), F.col("p_size").alias("size"))
    r = O.round_rings(c, 12, F.col("size").cast("double"), 0.5 * F.col("size"))
    return r.select("id", "pt_no", rounded("x").alias("x"), rounded("y").alias("y"))


@query("SELECT vec_id, NOT ((s0 > 0 OR s1 > 0 OR s2 > 0) AND (s0 < 0 OR s1 < 0 OR s2 < 0)) AS inside FROM (SELECT vec_id, (bx - ax) * (py - ay) - (yb - ay) * (px - ax) AS s0, (cx - bx) * (py - yb) - (cy - yb) * (px - bx) AS s1, (ax - cx) * (py - cy) - (ay - cy) * (px - cx) AS s2 FROM (SELECT vec_id, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS bx, embedding[4]::DOUBLE AS yb, embedding[5]::DOUBLE AS cx, embedding[6]::DOUBLE AS cy, embedding[7]::DOUBLE AS px, embedding[8]::DOUBLE AS py FROM embeddings))")
def point_in_corner_triangle(spark, sf_dir):
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(8)]
    return table(spark, sf_dir, "embeddings").select("vec_id", N.in_triangle(e[6], e[7], [(e[0], e[1]), (e[2], e[3]), (e[4], e[5])]).alias("inside"))
