"""Queries of distances, weights, votes, city shapes, wall units and moments, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospan.functions import geometry as G
from aerospan.operators import city as C
from aerospan.registry import query, rounded, table

#: In SQL: numbers e0, e1, ... of each embedding.
V = "v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(12)) + " FROM embeddings)"


def vectors(spark, sf_dir):
    e = [F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(12)]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *e)


def e(start: int, n: int = 2) -> list:
    return [F.col(f"e{k}") for k in range(start, start + n)]


def s_segment(p: int, a: int, b: int) -> str:
    """SQL of the squared distance of point e[p] to the segment e[a] - e[b] of the plane."""
    t = f"greatest(0, least(1, ((e{p} - e{a}) * (e{b} - e{a}) + (e{p + 1} - e{a + 1}) * (e{b + 1} - e{a + 1})) / (pow(e{b} - e{a}, 2) + pow(e{b + 1} - e{a + 1}, 2))))"
    return f"(pow(e{p} - e{a} - {t} * (e{b} - e{a}), 2) + pow(e{p + 1} - e{a + 1} - {t} * (e{b + 1} - e{a + 1}), 2))"


def s_side(a: int, b: int, p: int) -> str:
    return f"((e{b} - e{a}) * (e{p + 1} - e{a + 1}) - (e{b + 1} - e{a + 1}) * (e{p} - e{a}))"


@query(f"WITH {V}, t AS (SELECT *, greatest(0, ((e0 - e3) * e6 + (e1 - e4) * e7 + (e2 - e5) * e8) / (e6 * e6 + e7 * e7 + e8 * e8)) AS t FROM v) SELECT vec_id, round(pow(e0 - e3 - t * e6, 2) + pow(e1 - e4 - t * e7, 2) + pow(e2 - e5 - t * e8, 2), 6) AS d2 FROM t")
def point_ray_distance(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", rounded(G.point_ray(e(0, 3), e(3, 3), e(6, 3))).alias("d2"))


@query(f"WITH {V} SELECT vec_id, CASE WHEN {s_side(0, 2, 4)} * {s_side(0, 2, 6)} < 0 AND {s_side(4, 6, 0)} * {s_side(4, 6, 2)} < 0 THEN 0 ELSE round(least({s_segment(0, 4, 6)}, {s_segment(2, 4, 6)}, {s_segment(4, 0, 2)}, {s_segment(6, 0, 2)}), 6) END AS d2 FROM v")
def segment_distance(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", rounded(G.segment_segment(e(0), e(2), e(4), e(6))).alias("d2"))


@query(f"WITH {V}, n AS (SELECT *, e4 * e11 - e5 * e10 AS n0, e5 * e9 - e3 * e11 AS n1, e3 * e10 - e4 * e9 AS n2 FROM v) SELECT vec_id, round(pow((e6 - e0) * n0 + (e7 - e1) * n1 + (e8 - e2) * n2, 2) / (n0 * n0 + n1 * n1 + n2 * n2), 6) AS d2 FROM n")
def line_line_distance(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", rounded(G.line_line(e(0, 3), e(3, 3), e(6, 3), e(9, 3))).alias("d2"))


@query(f"WITH {V}, s AS (SELECT *, {s_side(2, 4, 0)} AS a, {s_side(4, 6, 0)} AS b, {s_side(6, 2, 0)} AS c FROM v) SELECT vec_id, CASE WHEN (a >= 0 AND b >= 0 AND c >= 0) OR (a <= 0 AND b <= 0 AND c <= 0) THEN 0 ELSE round(least({s_segment(0, 2, 4)}, {s_segment(0, 4, 6)}, {s_segment(0, 6, 2)}), 6) END AS d2 FROM s")
def point_triangle_distance(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", rounded(G.point_triangle(e(0), [e(2), e(4), e(6)])).alias("d2"))


def s_family(power: int) -> str:
    size = lambda k: f"pow(sqrt(pow(e{k} - e0, 2) + pow(e{k + 1} - e1, 2)), {power})"
    a, b, c = (f"{s_side(*x, 0)} / 2" for x in ((2, 4), (4, 6), (2, 6)))
    w = f"(({size(6)} * {a} - {size(4)} * {c} + {size(2)} * {b}) / ({a} * {b}))"
    return f"CASE WHEN abs({a} * {b}) > 1e-3 THEN round({w}, 5) END AS w{power}"


@query(f"WITH {V} SELECT vec_id, {s_family(0)}, {s_family(1)}, {s_family(2)} FROM v")
def three_point_weights(spark, sf_dir):
    """Weights of a vertex; not shown where the triangles are all but flat."""
    v = vectors(spark, sf_dir)
    wide = F.abs(G.side(*e(2), *e(4), *e(0)) / 2 * G.side(*e(4), *e(6), *e(0)) / 2) > 1e-3
    return v.select("vec_id", *(F.when(wide, rounded(G.three_point_weight(e(0), e(2), e(4), e(6), p), 5)).alias(f"w{p}") for p in (0, 1, 2)))


@query(f"WITH {V}, d AS (SELECT vec_id, e0 - e3 AS a0, e1 - e4 AS a1, e2 - e5 AS a2, e6 - e3 AS b0, e7 - e4 AS b1, e8 - e5 AS b2 FROM v) SELECT vec_id, round((a0 * b0 + a1 * b1 + a2 * b2) / sqrt(pow(a1 * b2 - a2 * b1, 2) + pow(a2 * b0 - a0 * b2, 2) + pow(a0 * b1 - a1 * b0, 2)), 5) AS cot FROM d")
def cotangent_weights(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", rounded(G.cotangent(e(0, 3), e(3, 3), e(6, 3)), 5).alias("cot"))


#: A small forest: splits (feature, threshold, left, right) and leaves (votes,).
FOREST = [
    {0: (0, 0.0, 1, 2), 1: ((1, 0, 0),), 2: (1, 0.05, 3, 4), 3: ((0.25, 0.5, 0.25),), 4: ((0, 0, 1),)},
    {0: (2, -0.02, 1, 2), 1: (3, 0.0, 3, 4), 2: ((0, 1, 0),), 3: ((0.5, 0.5, 0),), 4: ((0, 0.25, 0.75),)},
]
LEAVES = ["CASE WHEN e0 < 0 THEN {0} WHEN e1 < 0.05 THEN {1} ELSE {2} END", "CASE WHEN e2 < -0.02 THEN CASE WHEN e3 < 0 THEN {0} ELSE {1} END ELSE {2} END"]
VOTES = [((1, 0.25, 0), (0.5, 0, 0)), ((0, 0.5, 0), (0.5, 0.25, 1)), ((0, 0.25, 1), (0, 0.75, 0))]


@query(f"WITH {V} SELECT vec_id, " + ", ".join("(" + " + ".join(x.format(*v) for x, v in zip(LEAVES, votes, strict=True)) + f")::DOUBLE / 2 AS p{k}" for k, votes in enumerate(VOTES)) + " FROM v")
def forest_votes(spark, sf_dir):
    made = vectors(spark, sf_dir).select("vec_id", G.forest_votes(FOREST, F.array(*e(0, 4))).alias("p"))
    return made.select("vec_id", *(F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)))


def rings(spark, sf_dir):
    """A rectangle for each part: p_size times 10, from the origin."""
    s = F.col("p_size").cast("double")
    ring = F.array(*(F.struct((s * a).alias("x"), F.lit(10.0 * b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(ring).alias("pt_no", "p")).select("id", "pt_no", "p.x", "p.y")


@query("SELECT p_partkey AS id, k::INT AS pt_no, (CASE WHEN k IN (0, 3) THEN -1.5 ELSE p_size + 1.5 END)::DOUBLE AS x, (CASE WHEN k < 2 THEN -1.5 ELSE 11.5 END)::DOUBLE AS y FROM part, range(0, 4) t(k)")
def offset_rings(spark, sf_dir):
    return C.offset(rings(spark, sf_dir), 1.5).select("id", "pt_no", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query("SELECT p_partkey AS id, k::INT AS tri_no, 0 AS a, (k + 1)::INT AS b, (k + 2)::INT AS c, 30.0::DOUBLE AS z FROM part, range(0, 2) t(k)")
def domain_top(spark, sf_dir):
    return C.caps(rings(spark, sf_dir), 30.0)


@query("SELECT p_partkey AS id, round(p_size * sin(radians(30)) + 10 * cos(radians(30)), 6) AS width, round((p_size * sin(radians(30)) + 10 * cos(radians(30))) * p_retailprice / 100, 4) AS area FROM part")
def blockage_areas(spark, sf_dir):
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("height"))
    return C.blockage(rings(spark, sf_dir), h, 30.0).select("id", rounded(F.col("width")).alias("width"), rounded(F.col("area"), 4).alias("area"))


@query("""WITH c AS (SELECT c_custkey AS node_id, (c_custkey % 2500) / 100.0::DOUBLE AS x, c_acctbal / 100 AS y FROM customer), s AS (SELECT s_suppkey AS id, (s_suppkey % 250) / 10.0::DOUBLE AS x, s_acctbal / 100 AS y, s_acctbal / 10 AS slope FROM supplier),
d AS (SELECT node_id, slope, pow(c.x - s.x, 2) + pow(c.y - s.y, 2) AS d2, row_number() OVER (PARTITION BY node_id ORDER BY pow(c.x - s.x, 2) + pow(c.y - s.y, 2), id) AS k FROM c, s)
SELECT node_id, round(sqrt(d2), 6) AS distance, round(sqrt(d2) * sqrt(0.002 * abs(slope)) / 0.002, 3) AS y_plus FROM d WHERE k = 1""")
def wall_units(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), ((F.col("c_custkey") % 2500) / 100.0).alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 250) / 10.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"), (F.col("s_acctbal") / 10).alias("slope"))
    return C.wall_units(c, s, 0.002, ["x", "y"], 2.0).select("node_id", rounded(F.col("distance")).alias("distance"), rounded(F.col("y_plus"), 3).alias("y_plus"))


TWO = [(i, j) for i in range(3) for j in range(i, 3)]
THREE = [(i, j, k) for i in range(3) for j in range(i, 3) for k in range(j, 3)]


@query(f"WITH {V}, m AS (SELECT *, " + ", ".join(f"e{i} - avg(e{i}) OVER (PARTITION BY label) AS u{i}" for i in range(3)) + " FROM v) SELECT label, " + ", ".join(f"round(avg({' * '.join(f'u{i}' for i in at)}), 6) AS {'r' if len(at) == 2 else 't'}{''.join(map(str, at))}" for at in (*TWO, *THREE)) + " FROM m GROUP BY label")
def stresses_and_triples(spark, sf_dir):
    m = C.central_moments(vectors(spark, sf_dir), ["label"], e(0, 3))
    return m.select("label", *(rounded(F.col(c)).alias(c) for c in m.columns[1:]))


@query("SELECT round(sum(CASE WHEN l_quantity >= 5 THEN l_extendedprice END), 2) AS nansum, count(CASE WHEN l_quantity >= 5 THEN 1 END) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def global_reductions(spark, sf_dir):
    """Reductions over a whole table; the sum takes missing values (NaN) as zero."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    v = table(spark, sf_dir, "lineitem").select(p, F.when(q >= 5, p).otherwise(F.lit(float("nan"))).alias("v"))
    return v.agg(rounded(F.sum(F.nanvl("v", F.lit(None).cast("double"))), 2).alias("nansum"), F.count_if(~F.isnan("v")).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"))


@query("SELECT p_partkey, (p_size > 10 AND p_size < 30) OR (p_size = 10 AND p_partkey % 2 = 0) OR (p_size = 30 AND p_partkey % 3 = 0) AS holds, 10 <= p_size AND 30 >= p_size + p_partkey % 7 AS holds_interval FROM part")
def interval_contains(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    held = C.contains(F.lit(10), F.lit(30), k % 2 == 0, k % 3 == 0, s)
    return table(spark, sf_dir, "part").select("p_partkey", held.alias("holds"), C.contains_interval(F.lit(10), F.lit(30), s, s + k % 7).alias("holds_interval"))
