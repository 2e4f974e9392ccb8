"""Hexahedra of 27 and 64 nodes: node order, masses, gradients of the element's own polynomials, bent ones located."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospan.functions import shapes
from aerospan.operators import locate as L
from aerospan.operators import mesh as M

KINDS = [(39, 2), (40, 3)]


def bricks(spark, degree, ltype, n=2, bend=0.0):
    """n^3 hexahedra in a cube of side n; ``bend`` moves nodes along a smooth curve."""
    own = (shapes.line(degree)[0] + 1) / 2
    side = n * degree + 1
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    xyz = grid // degree + own[grid % degree] * (grid % degree > 0)
    xyz = xyz + bend * np.sin(np.pi * xyz[:, [1, 2, 0]] / n)
    number = lambda g: (g[0] * side + g[1]) * side + g[2]
    elements = [(k, ltype, [int(number(degree * np.array(cell) + p)) for p in shapes.lattice(degree)]) for k, cell in enumerate(np.ndindex(n, n, n))]
    nodes = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(xyz)], "node_id long, x double, y double, z double")
    return xyz, nodes, spark.createDataFrame(elements, "elem_id long, ltype int, nodes array<long>")


@pytest.mark.parametrize("ltype, degree", KINDS)
def test_shape_functions(ltype, degree):
    places = shapes.lattice(degree)
    assert len({tuple(p) for p in places}) == len(places) == (degree + 1) ** 3
    on_ends = [sum(v in (0, degree) for v in p) for p in places]
    assert on_ends == sorted(on_ends, reverse=True)  # corners, edges, faces, inside
    n, slopes = shapes.evaluated(ltype, shapes.line(degree)[0][places])
    assert np.allclose(n, np.eye(len(places))) and np.allclose(slopes.sum(axis=1), 0)
    xi, h = np.random.default_rng(0).uniform(-1, 1, (50, 3)), 1e-6
    slopes = shapes.evaluated(ltype, xi)[1]
    for d in range(3):
        step = h * np.eye(3)[d]
        assert np.allclose(slopes[..., d], (shapes.evaluated(ltype, xi + step)[0] - shapes.evaluated(ltype, xi - step)[0]) / (2 * h), atol=1e-7)
    reach = np.abs(shapes.evaluated(ltype, np.random.default_rng(1).uniform(-1, 1, (5000, 3)))[0]).sum(axis=1).max()
    assert (reach - 1) / 2 <= shapes.bulge(ltype)


@pytest.mark.parametrize("ltype, degree", KINDS)
def test_masses_and_gradients(spark, ltype, degree):
    xyz, nodes, elements = bricks(spark, degree, ltype)
    mass = {r.node_id: r.mass for r in M.lumped_mass(elements, nodes).collect()}
    assert len(mass) == len(xyz) and sum(mass.values()) == pytest.approx(8.0)
    rows = {}
    for r in M.consistent_mass(elements, nodes).collect():
        rows[r.i] = rows.get(r.i, 0.0) + r.v
    assert rows == pytest.approx(mass)
    # a polynomial of the element's degree along each axis: slopes on the mesh are those of the field, so weak sums agree
    p = lambda q: q[:, 0] ** degree * q[:, 1] - 2 * q[:, 2] ** degree + q[:, 0] * q[:, 1] * q[:, 2]
    x, y, z = xyz.T
    want = np.stack([degree * x ** (degree - 1) * y + y * z, x**degree + x * z, x * y - 2 * degree * z ** (degree - 1)], axis=1)
    field = spark.createDataFrame([(k, float(v)) for k, v in enumerate(p(xyz))], "node_id long, f double")
    got = {r.node_id: (r.gx, r.gy, r.gz) for r in M.nodal_gradients(elements, nodes, field, "f").collect()}
    got = np.array([got[k] for k in range(len(xyz))])
    weights = np.array([mass[k] for k in range(len(xyz))])
    # the projection keeps integrals: of x^d y over the cube by x it is 2^d * 2 * 2, and so on
    assert np.allclose(weights @ got[:, 0], 2**degree * 4 + 8, atol=1e-8)
    assert np.allclose(weights @ got[:, 1], 2 ** (degree + 1) / (degree + 1) * 4 + 8, atol=1e-8)
    assert np.allclose(weights @ got[:, 2], 8 - 2 * 2**degree * 4, atol=1e-8)
    linear = spark.createDataFrame([(k, float(v @ [1.0, -2.0, 0.5])) for k, v in enumerate(xyz)], "node_id long, f double")
    flat = np.array([(r.gx, r.gy, r.gz) for r in M.nodal_gradients(elements, nodes, linear, "f").collect()])
    assert np.allclose(flat, [1.0, -2.0, 0.5])
    j, _ = shapes.jacobians(xyz[np.array([r.nodes for r in elements.orderBy("elem_id").collect()])], ltype)
    assert j.shape[0] == 8 and want.shape == got.shape


@pytest.mark.parametrize("ltype, degree", KINDS)
def test_points_in_bent_elements(spark, ltype, degree):
    xyz, nodes, elements = bricks(spark, degree, ltype, bend=0.12)
    xi = np.random.default_rng(4).uniform(-1, 1, (40, 3))
    of = np.array([r.nodes for r in elements.orderBy("elem_id").collect()])
    which = np.arange(40) % 8
    at = np.einsum("mk,mkc->mc", shapes.evaluated(ltype, xi)[0], xyz[of[which]])
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(at)] + [(99, 9.0, 9.0, 9.0)], "id long, x double, y double, z double")
    found = {r.id: r for r in L.located(points, elements, nodes).collect()}
    assert {k: r.elem_id for k, r in found.items()} == dict(enumerate(which.tolist()))
    field = spark.createDataFrame([(k, float(v @ [1.0, 2.0, 3.0])) for k, v in enumerate(xyz)], "node_id long, f double")
    got = {r.id: r.f for r in L.interpolated(points, elements, nodes, field, ["f"], "fem").collect()}
    assert got.pop(99) is None and [got[k] for k in range(40)] == pytest.approx((at @ [1.0, 2.0, 3.0]).tolist())


def test_elements_with_unknown_nodes(spark):
    _, nodes, elements = bricks(spark, 2, 39)
    assert M.lumped_mass(elements, nodes.where(F.col("node_id") > 0)).agg(F.sum("mass")).first()[0] == pytest.approx(7.0)
    assert M.lumped_mass(elements.where("false"), nodes).count() == 0
