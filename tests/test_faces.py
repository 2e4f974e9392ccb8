"""Faces of solids: closed surfaces, outward normals, and the divergence theorem on meshes of every type, also left-handed ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospan.functions import shapes
from aerospan.operators import faces as B
from tests.test_locate import cube, frames


@pytest.mark.parametrize("kind", [30, 32, 34, 37])
def test_surfaces_are_closed(spark, kind):
    xyz, elements = cube(2, kind)
    if kind in (30, 37):  # every second element numbered the other way round
        flip = {30: [0, 2, 1, 3], 37: [0, 3, 2, 1, 4, 7, 6, 5]}[kind]
        elements = [[e[k] for k in flip] if n % 2 else e for n, e in enumerate(elements)]
    field = np.stack([xyz[:, 0] * 2 + xyz[:, 1], xyz[:, 2] * 3], axis=1)
    nodes, elems, f = frames(spark, xyz, elements, kind, field)
    skin = B.area_vectors(B.boundary_faces(elems), elems, nodes)
    rows = skin.collect()
    assert np.abs(np.sum([r.normal for r in rows], axis=0)).max() < 1e-12
    sides = np.array([r.centre for r in rows])
    assert all(np.isclose(sides, 0).any(axis=1) | np.isclose(sides, 1).any(axis=1))  # the cube's own faces
    assert all(np.dot(r.normal, np.array(r.centre) - 0.5) > 0 for r in rows)
    assert sum(np.linalg.norm(r.normal) for r in rows) == pytest.approx(6.0)
    whole = f.select("node_id", "f", "g", F.lit(1.0).alias("h"))
    # of (2 x + y, 3 z, 1) the divergence is 2
    assert B.flux(skin, whole, ["f", "g", "h"]).first().flux == pytest.approx(2.0, abs=1e-9)
    shared, alone = B.neighbours(elems).count(), len(rows)
    assert shared + alone == B.faces(elems).count() == len(elements) * len(B.FACES[kind])
    each = B.area_vectors(B.faces(elems), elems, nodes).groupBy("elem_id").agg(*(F.sum(F.get("normal", F.lit(k))).alias(f"n{k}") for k in range(3))).collect()
    assert max(abs(v) for r in each for v in r[1:]) < 1e-12  # each element is closed by itself
    corner = {r.node_id: r.normal for r in B.node_normals(skin).collect()}[0]
    assert all(v < 0 for v in corner) and np.linalg.norm(corner) == pytest.approx(1.0)
    assert B.boundary_faces(elems.where("false")).count() == 0


def test_faces_agree_with_volumes(spark):
    """The flux of the place through each element's faces is three times its volume by Gauss points."""
    xyz, elements = cube(2, 30)
    nodes, elems, _ = frames(spark, xyz, elements, 30, np.zeros((len(xyz), 2)))
    v = B.area_vectors(B.faces(elems), elems, nodes)
    dot = sum((F.get("normal", F.lit(k)) * F.get("centre", F.lit(k)) for k in range(3)), F.lit(0.0))
    got = {r.elem_id: r.v for r in v.groupBy("elem_id").agg((F.sum(dot) / 3).alias("v")).collect()}
    want = shapes.jacobians(np.array([xyz[e] for e in elements]), 30)[1].sum(axis=1)
    assert [got[k] for k in range(len(elements))] == pytest.approx(want.tolist())
