"""Long transforms in blocks: against NumPy, in many groups, and what they shuffle."""

import numpy as np
import pytest

from aerospan.operators import signals as G
from aerospan.operators import transforms as T


@pytest.mark.parametrize("n", [1, 3, 97, 256, 1000])
@pytest.mark.parametrize("block", [0, 4, 18])
def test_blocks_of_any_size(spark, n, block):
    y = np.random.default_rng(n).normal(size=n)
    rows = [("a", n, i, float(v)) for i, v in enumerate(y)] + [(None, n, i, float(v)) for i, v in enumerate(y[::-1])]
    got = {(r._by, r.k): complex(r.re, r.im) for r in T.chirped(spark.createDataFrame(rows, "_by string, n long, _j long, _v double"), "string", block).collect()}
    for name, want in (("a", np.fft.rfft(y)), (None, np.fft.rfft(y[::-1]))):
        assert np.allclose([got.pop((name, k)) for k in range(len(want))], want)
    assert not got


@pytest.mark.parametrize("block", [0, 5, 18])
def test_samples_are_spread_within_groups_of_columns(spark, block):
    """Samples at both ends and within a curve's reach of each other's groups; no row a place of the mesh on the way."""
    rng = np.random.default_rng(4)
    t = np.sort(np.concatenate([[0.0, 1e-9, 20.0], rng.random(37) * 20]))
    y = rng.normal(size=len(t)) + np.cos(3 * t)
    df = G.lomb_grid(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)], "name string, t double, y double"), "name", "t", "y", 2.0, 1.0, block)
    got = {r.k: r.power for r in df.collect()}
    assert sorted(got) == list(range(1, len(t) + 1))
    d = y - y.mean()
    for k, power in got.items():
        a = 2 * np.pi * k / (2 * 20.0) * t
        a = a - np.arctan2(np.sin(2 * a).sum(), np.cos(2 * a).sum()) / 2
        c, s = np.cos(a), np.sin(a)
        assert abs(power - ((d @ c) ** 2 / (c @ c) + (d @ s) ** 2 / (s @ s)) / 2 / y.var(ddof=1)) < 1e-6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_data" in plan and "Generate explode(sequence" not in plan  # samples were exploded over the mesh


def test_numbers_of_a_hot_series(spark):
    """Rows of one series are numbered in many tasks, ties in ``along`` by the order, as in one window."""
    rows = [(["a", "b", None][k % 3], float(k * 7 % 50), k) for k in range(400)]
    got = G.numbered(spark.createDataFrame(rows, "s string, t double, id long"), "s", ["t", "id"], "t").collect()
    for name in ("a", "b", None):
        want = sorted((t, k) for s, t, k in rows if s == name)
        assert [(r.t, r.id) for r in sorted((r for r in got if r.s == name), key=lambda r: r.i)] == want
        assert sorted(r.i for r in got if r.s == name) == list(range(len(want))) and {r.n for r in got if r.s == name} == {len(want)}
