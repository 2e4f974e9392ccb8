"""Rigid rotation against eigenvectors found by NumPy."""

import numpy as np
from pyspark.sql import functions as F

from aerospan.functions.vectors import real_schur
from aerospan.operators.vortices import rigid_rotation


def plain(a, eps=1e-3):
    w, v = np.linalg.eig(a)
    k = int(np.abs(w.imag).argmin())
    swirl = np.abs(w.imag).max()
    if swirl == 0:
        return 0.0, 0.0, None, 0.0
    r = np.real(v[:, k]) / np.linalg.norm(np.real(v[:, k]))
    b = np.array([a[2, 1] - a[1, 2], a[0, 2] - a[2, 0], a[1, 0] - a[0, 1]]) @ r / 2
    r, b = (r, b) if b > 0 else (-r, -b)
    c = np.sqrt(max(0.0, b * b - swirl * swirl))
    return swirl, 2 * (b - c), r, b * b / (b * b + c * c + eps)


def test_rigid_rotation(spark):
    rng = np.random.default_rng(11)
    a = [*rng.normal(size=(300, 3, 3)), np.array([[0, -2.0, 0], [2, 0, 0], [0, 0, 0]]), np.diag([1.0, 2, 3]), np.zeros((3, 3)), np.array([[0, 1.0, 0], [0, 0, 0], [0, 0, 0]]), np.array([[0, 0, 3.0], [0, 0.5, 0], [-3, 0, 0]])]
    rows = [(i, m.ravel().tolist()) for i, m in enumerate(a)] + [(-1, None), (-2, [1.0] * 8 + [None])]
    got = {r.id: r for r in rigid_rotation(spark.createDataFrame(rows, "id long, g array<double>"), "g").collect()}
    for i, m in enumerate(a):
        swirl, size, axis, share = plain(m)
        assert np.allclose([got[i].swirl, got[i].rortex, got[i].omega_rortex], [swirl, size, share], atol=1e-6), (i, m)
        if axis is not None and size > 1e-3:
            assert np.allclose(got[i].rortex_axis, axis, atol=1e-6)
    assert abs(got[300].rortex - 4) < 1e-6 and got[303].rortex == 0  # a rigid body at angular speed 2; plain shear
    assert got[-1].rortex is None and got[-2].rortex is None and got[-1].swirl is None


def test_rotation_in_codegen_without_python(spark):
    df = spark.range(10).select(F.array(*(F.rand(k) for k in range(9))).alias("g"))
    plan = rigid_rotation(df, "g")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_schur_of_a_batch():
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=(200, 3, 3)), np.eye(3)[None], np.zeros((1, 3, 3)), np.diag([3.0, 2, 1])[None]])
    s, q = real_schur(a)
    assert np.allclose(q @ s @ q.transpose(0, 2, 1), a) and np.allclose(q @ q.transpose(0, 2, 1), np.eye(3))
    assert np.allclose(s[:, 2, :2], 0, atol=1e-9)
