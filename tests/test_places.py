"""Places over all rows, Gauss projections of every element type, rings around centres, solved systems."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospan.functions.shapes import DEGREES, lattice, rule
from aerospan.operators import mesh as M
from aerospan.operators import polygons as G
from aerospan.operators import sparse as P
from aerospan.operators import statistics as A

CORNERS = {
    2: [(0, 0, 0), (2, 0, 0)],
    10: [(0, 0, 0), (2, 0, 0), (0, 1, 0)],
    12: [(0, 0, 0), (2, 0, 0), (2.5, 1, 0), (0, 1, 0)],
    30: [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 2)],
    32: [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 1)],
    34: [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)],
    37: [(x, y, z) for z in (0, 1) for x, y in ((0, 0), (1, 0), (1.2, 1), (0, 1))],
} | {t: [tuple(float(x) for x in p) for p in lattice(d)] for t, d in DEGREES.items()}


def test_places_by_ranges(spark):
    rows = [(i, None if i % 7 == 0 else (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    got = {r.id: r.place for r in A.in_places(df, F.col("v").asc_nulls_last(), F.col("id")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {r[0]: k for k, r in enumerate(order, 1)}
    plan = A.in_places(df, F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]  # only the counts of ranges meet in one task


def test_places_of_nothing_and_one_value(spark):
    assert A.in_places(spark.createDataFrame([], "id long"), F.col("id")).count() == 0
    df = spark.range(500).select("id", F.lit(1).alias("v"))
    assert {r.id: r.place for r in A.in_places(df, F.col("v"), F.col("id")).collect()} == {k: k + 1 for k in range(500)}


@pytest.mark.parametrize("ltype", sorted(CORNERS))
def test_gauss_points_and_back(spark, ltype):
    """Constants come back as they are; anything else as the plain sums say."""
    p = np.array(CORNERS[ltype], float)
    nodes = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "node_id long, x double, y double, z double")
    elements = spark.createDataFrame([(0, ltype, list(range(len(p))))], "elem_id long, ltype int, nodes array<long>")
    f = np.sin(np.arange(len(p)) * 1.3) + 2
    field = spark.createDataFrame([(k, float(v), 5.0) for k, v in enumerate(f)], "node_id long, f double, g double")
    gauss = M.to_gauss(elements, nodes, field, "f")
    n = rule(ltype)[1]
    assert np.allclose([r.f for r in gauss.orderBy("gp").collect()], n @ f)
    back = M.from_gauss(elements, nodes, M.to_gauss(elements, nodes, field, "g"), "g").collect()
    assert len(back) == len(p) and all(abs(r.g - 5) < 1e-9 for r in back)
    w = M.jacobians(p[None], ltype)[1][0]
    got = {r.node_id: r.f for r in M.from_gauss(elements, nodes, gauss, "f").collect()}
    assert np.allclose([got[k] for k in range(len(p))], (n.T @ (w * (n @ f))) / (n.T @ w))


def test_round_rings(spark):
    c = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id long, x double, y double, r double")
    ring = G.round_rings(c, 8, F.col("r"), F.col("r") / 2).orderBy("pt_no").collect()
    assert all(math.isclose(((q.x - 2) / 4) ** 2 + ((q.y - 3) / 2) ** 2, 1) for q in ring) and len(ring) == 8
    arc = G.round_rings(c, 3, F.col("r"), step=math.pi / 2, start=math.pi).orderBy("pt_no").collect()
    assert np.allclose([(q.x, q.y) for q in arc], [(-2, 3), (2, -1), (6, 3)])


def test_solver_with_uneven_diagonal(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(12, 12))
    d = np.diag(10.0 ** np.linspace(-2, 2, 12))
    a = d @ (q @ q.T + 12 * np.eye(12)) @ d
    x = rng.normal(size=12)
    rows = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a @ x)], "i long, b double")
    got = {r.i: r.x for r in P.conjugate_gradient(rows, b, tol=1e-20).collect()}
    assert np.allclose([got[i] for i in range(12)], x, rtol=1e-6, atol=1e-6)
    zero = spark.createDataFrame([(i, 0.0) for i in range(12)], "i long, b double")
    assert all(r.x == 0 for r in P.conjugate_gradient(rows, zero).collect())


def test_lumped_and_implicit_matrices(spark):
    m = spark.createDataFrame([(0, 2.0), (1, 0.0), (2, 4.0)], "i long, m double")
    b = spark.createDataFrame([(0, 1.0), (1, 1.0), (3, 1.0)], "i long, b double")
    assert {r.i: r.x for r in P.lumped(m, b).collect()} == {0: 0.5, 1: None}
    made = P.from_rule(spark.range(3).select(F.col("id").alias("i")), 2, lambda i, j: F.when(i >= j, i + 10 * j))
    assert {(r.i, r.j, r.v) for r in made.collect()} == {(0, 0, 0), (1, 0, 1), (2, 0, 2), (1, 1, 11), (2, 1, 12)}
