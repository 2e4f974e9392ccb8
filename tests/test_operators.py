"""Cases that the tables do not hold: missing values, singular tensors, golden results, and iterative operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospan.functions import numeric as N
from aerospan.functions import vectors as V
from aerospan.operators import mesh as M
from aerospan.operators import series as S
from aerospan.operators import signals as G
from aerospan.operators import sparse as P
from aerospan.operators import spatial as X
from aerospan.operators import statistics as A
from aerospan.operators import tiles as T

NAN = float("nan")


def test_nan_is_missing_in_reducers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (NAN, 1.0), (3.0, 3.0)], "r double, m double")
    got = df.agg(*(c.alias(k) for k, c in A.errors(F.col("r"), F.col("m")).items())).first()
    assert got.mae == 0.5 and got.bias == 0.5 and got.covariance == 0.5
    assert df.agg(*(c.alias(k) for k, c in A.summary(F.col("r")).items())).first().has_nan


def test_reducers_on_nothing(spark):
    df = spark.createDataFrame([], "r double, m double")
    got = df.agg(*(c.alias(k) for k, c in A.errors(F.col("r"), F.col("m")).items())).first()
    assert got.mae is None and got.pearson is None


def test_fill_edges(spark):
    df = spark.createDataFrame([("a", 0, NAN), ("a", 1, 1.0), ("a", 2, NAN), ("a", 3, NAN), ("a", 4, 4.0), ("a", 5, NAN), ("b", 0, NAN)], "k string, i int, v double")
    got = {(r.k, r.i): r.v for r in S.fill(df, "v", "i", ["k"]).collect()}
    assert [got["a", k] for k in range(6)] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0] and got["b", 0] is None


def test_clamps_keep_nan(spark):
    df = spark.createDataFrame([([1.0, NAN, -1.0],)], "a array<double>")
    low, high = df.select(V.at_least(F.col("a"), 0.0), V.at_most(F.col("a"), 0.0)).first()
    assert low[0] == 1.0 and np.isnan(low[1]) and low[2] == 0.0
    assert high[0] == 0.0 and np.isnan(high[1]) and high[2] == -1.0


def test_inverse_and_singular(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=9).tolist()) for k in range(20)] + [(99, [1.0] * 9)]
    got = {r.k: r.b for r in spark.createDataFrame(rows, "k int, a array<double>").select("k", V.inverse(V.inverse(F.col("a"))).alias("b")).collect()}
    assert got[99] is None
    for k, a in rows[:-1]:
        assert np.allclose(got[k], a, rtol=1e-6)


def test_schur_identities():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.normal(size=(3, 3))
        s, q = (np.array(x).reshape(3, 3) for x in V.real_schur(a.ravel().tolist()))
        assert np.allclose(q @ s @ q.T, a) and np.allclose(q @ q.T, np.eye(3))
        assert np.allclose(s[2, :2], 0, atol=1e-9)


def test_eigenvalues_match_a_solver(spark):
    rng = np.random.default_rng(2)
    mats = [(m + m.T) / 2 for m in rng.normal(size=(20, 3, 3))] + [np.eye(3) * 2]
    df = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(mats)], "k int, a array<double>")
    for r in df.select("k", V.eigenvalues(F.col("a")).alias("e")).collect():
        assert np.allclose(r.e, np.linalg.eigvalsh(mats[r.k]), atol=1e-7)


def test_lobatto_integrates_exactly():
    x, w = N.lobatto(6)
    assert x[:2] == [-1.0, 1.0]
    for p in range(10):
        assert np.isclose(np.dot(w, np.power(x, p)), (1 + (-1) ** p) / (p + 1))


def test_golden_blend(spark):
    """Four constant tiles of 2 x 2, overlap 1."""
    t = spark.createDataFrame([(k, i, j, float(k + 1)) for k in range(4) for i in range(2) for j in range(2)], "tile long, i long, j long, v double")
    got = np.zeros((4, 4))
    for r in T.blend(t, 2, 1, 1, 4, 2, 1.5, 1.5).collect():
        got[r.row, r.col] = r.v
    assert got.tolist() == [[0, 0, 0, 0], [3, 3, 4, 0], [3, 3, 4, 0], [1, 1, 2, 0]]


def test_box_joins_match_nested_loops(spark):
    rng = np.random.default_rng(3)
    lo = rng.integers(0, 30, (60, 3))
    hi = lo + rng.integers(0, 6, (60, 3))
    rows = [(k, *map(float, (a[0], b[0], a[1], b[1], a[2], b[2]))) for k, (a, b) in enumerate(zip(lo, hi, strict=True))]
    df = spark.createDataFrame(rows, "id long, x_lo double, x_hi double, y_lo double, y_hi double, z_lo double, z_hi double")
    for closed in (True, False):
        got = {(r.id, r.other) for r in X.box_join(df, df, ["x", "y", "z"], [4.0, 4.0, 4.0], closed).collect()}
        lt = np.less_equal if closed else np.less
        want = {(i, j) for i in range(60) for j in range(60) if (lt(lo[i], hi[j]) & lt(lo[j], hi[i])).all()}
        assert got == want


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    p, q = rng.normal(size=(300, 3)), rng.normal(size=(20, 3)) * 3
    pts = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, z double")
    qs = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(q)], "query long, x double, y double, z double")
    got = {(r.query, r.place): r.id for r in X.nearest(pts, qs, 3, ["x", "y", "z"], 0.1).collect()}
    for k, v in enumerate(q):
        want = np.argsort(((p - v) ** 2).sum(axis=1), kind="stable")[:3]
        assert [got[k, n + 1] for n in range(3)] == want.tolist()


def test_intervals(spark):
    i = spark.createDataFrame([(k, float(k), float(k + 3), True, True) for k in range(10)], "id long, lo double, hi double, lc boolean, rc boolean")
    p = spark.createDataFrame([(k, float(k)) for k in range(13)], "probe long, v double")
    got = {(r.probe, r.id) for r in X.stab(i, p, 2.0).collect()}
    assert got == {(v, k) for v in range(13) for k in range(10) if k <= v <= k + 3}


def test_solvers_agree_with_a_direct_one(spark):
    a, b = P.example(spark)
    m = np.zeros((9, 9))
    for r in a.collect():
        m[r.i, r.j] = r.v
    want = np.linalg.solve(m, np.sin(np.arange(9)))
    got = np.array([r.x for r in P.conjugate_gradient(a, b).orderBy("i").collect()])
    assert np.allclose(got, want, atol=1e-5 * np.abs(want).max())


def test_gradient_of_a_field(spark):
    nodes, quads = M.plane_nodes(spark, (1.0, 1.0), 17, 17), M.plane_elements(spark, 17, 17)
    f = nodes.select("node_id", F.sin(F.col("x")).alias("f"))
    g = M.gradient(M.triangles_of(quads), nodes, f, "f").join(nodes, "node_id")
    worst = g.agg(F.max(F.abs(F.col("gx") - F.cos("x"))), F.max(F.abs("gy"))).first()
    assert worst[0] < 0.04 and worst[1] < 1e-9


def test_volumes(spark):
    nodes, cells = M.cube_nodes(spark, (1.0, 2.0, 3.0), 4, 3, 5), M.cube_elements(spark, 4, 3, 5)
    assert np.isclose(M.measured(cells, nodes).agg(F.sum("w")).first()[0], 6.0)
    assert np.isclose(M.lumped_mass(cells, nodes).agg(F.sum("mass")).first()[0], 6.0)


def test_hull(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(200, 2))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in p], "grp string, x double, y double")
    got = [(r.x, r.y) for r in X.hulls(df).orderBy("place").collect()]
    for (ax, ay), (bx, by) in zip(got, got[1:] + got[:1], strict=True):
        assert ((bx - ax) * (p[:, 1] - ay) - (by - ay) * (p[:, 0] - ax) >= -1e-12).all()


def test_hilbert_order_is_a_walk(spark):
    cells = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    got = sorted((r.d, r.x, r.y) for r in cells.select("x", "y", N.hilbert(F.col("x"), F.col("y"), 3).alias("d")).collect())
    assert [d for d, *_ in got] == list(range(64))
    assert all(abs(a - c) + abs(b - d) == 1 for (_, a, b), (_, c, d) in zip(got, got[1:], strict=False))


def test_welch_matches_segments(spark):
    from aerospan.operators import signals as G

    y = np.random.default_rng(6).normal(size=40)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(y)], "s string, i long, v double")
    got = np.array([r.power for r in G.welch(df, "s", "i", "v", 16, 8).orderBy("k").collect()])
    w = np.hanning(16)
    want = np.mean([np.abs(np.fft.rfft((y[a : a + 16] - y[a : a + 16].mean()) * w)) ** 2 / (w**2).sum() for a in range(0, 25, 8)], axis=0)
    assert np.allclose(got, want)


def test_quadtree_leaves_hold_every_point(spark):
    rng = np.random.default_rng(7)
    pts = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((300, 2)) ** 2)], "id long, x double, y double")
    got = [(r.path, r.n) for r in X.leaves(X.quadtree(pts, 5, 1.0), 20).collect()]
    assert sum(n for _, n in got) == 300 and all(n <= 20 or len(p) == 5 for p, n in got)


def test_approximate_inverse_approaches_the_solution(spark):
    a, b = P.example(spark)
    m = np.zeros((9, 9))
    for r in a.collect():
        m[r.i, r.j] = r.v
    x, rest, lumped = np.zeros(9), np.sin(np.arange(9)), m.sum(axis=1)
    for _ in range(6):
        d = rest / lumped
        x, rest = x + d, rest - m @ d
    got = np.array([r.x for r in P.approximate_inverse(a, b, 6).orderBy("i").collect()])
    assert np.allclose(got, x)


def test_nearest_dense_in_blocks(spark):
    """More queries than a block holds, against brute force."""
    v = np.random.default_rng(3).integers(0, 9, (40, 3)).astype(float)
    e = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = sorted((r.query, r.place, r.id, r.d2) for r in X.nearest_dense(e, e.withColumnRenamed("id", "query"), 3, "v", most=15).collect())
    d2 = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    assert got == [(q, n + 1, i, d2[q, i]) for q in range(40) for n, i in enumerate(sorted(range(40), key=lambda i: (d2[q, i], i))[:3])]


def test_nearest_dense_in_tiles(spark, monkeypatch):
    """More points than a tile holds, copies, and vectors without distances, against brute force; nothing is broadcast or paired in SQL."""
    monkeypatch.setattr(X, "DENSE", 25)
    monkeypatch.setattr(X, "AT_ONCE", 64)
    v = np.random.default_rng(5).normal(size=(60, 7))
    v[30:50] = v[10]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(60, None), (61, [None] * 7), (62, [1.0]), (63, [1e200] * 7), (64, [float("nan")] * 7)]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    found = X.nearest_dense(e, e.withColumnRenamed("id", "query"), 62, "v", most=15)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {q: [] for q, _ in rows}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got[r.query].append((r.id, r.d2))

    def apart(a, b):
        if a is None or b is None or len(a) != len(b) or None in a + b:
            return None
        return sum((np.square(np.float64(x) - y) for x, y in zip(a, b, strict=True)), 0.0)

    for q, a in rows:
        want = [(i, apart(b, a)) for i, b in rows]
        want = sorted(want, key=lambda r: (r[1] is None, r[1] is not None and np.isnan(r[1]), 0.0 if r[1] is None or np.isnan(r[1]) else r[1], r[0]))[:62]
        assert [(i, str(d)) for i, d in got[q]] == [(i, str(None if d is None else float(d))) for i, d in want]


def test_a_star_is_not_convex(spark):
    star = [(float(np.cos(4 * np.pi * k / 5)), float(np.sin(4 * np.pi * k / 5))) for k in range(5)]
    rings = {1: star, 2: [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], 3: [(0.0, 0.0), (2.0, 0.0), (0.5, 0.5), (0.0, 2.0)], 4: [(0.0, 0.0), (0.0, 3.0), (3.0, 0.0)]}
    df = spark.createDataFrame([(i, k, x, y) for i, ring in rings.items() for k, (x, y) in enumerate(ring)], "id int, pt_no int, x double, y double")
    assert {r.id: r.convex for r in X.convex(df).collect()} == {1: False, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("n, overlap", [(4, 1), (4, 2), (4, 3), (5, 4)])
def test_blending_upwards_by_any_overlap(spark, n, overlap):
    """Against tiles blended one after the other."""
    rng = np.random.default_rng(3)
    frames, raw = 2, rng.normal(size=(6, n, n))
    df = spark.createDataFrame([(t, i, j, float(raw[t, i, j])) for t in range(6) for i in range(n) for j in range(n)], "tile long, i long, j long, v double")
    got = {(r.tile, r.i, r.j): r.v for r in T.upwards(df, n, overlap, frames, 1.5).collect()}
    done = []
    for t in range(6):
        tile = raw[t].copy()
        if t >= frames:
            for k in range(overlap):
                w = np.exp(-1.5 * k / (overlap - 1)) if overlap > 1 else 1.0
                tile[n - overlap + k] = tile[n - overlap + k] * w + done[t - frames][k] * (1 - w)
        done.append(tile)
    assert all(abs(got[t, i, j] - done[t][i, j]) < 1e-12 for t in range(6) for i in range(n) for j in range(n))


def test_covariance_is_about_the_means_of_all_known_values(spark):
    x, y = np.array([1.0, 2.0, 4.0, NAN, 9.0]), np.array([3.0, NAN, 1.0, 5.0, 2.0])
    got = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").agg(A.covariance(F.col("x"), F.col("y")).alias("c")).first().c
    assert abs(got - np.nanmean((x - np.nanmean(x)) * (y - np.nanmean(y)))) < 1e-12


def test_series_in_slices_agree_with_one_window(spark):
    """Steps, running means and fills, with a null key and slices without rows."""
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.random(200) * rng.choice([0.01, 5.0], 200)) + 1
    rows = [(None if k % 3 == 0 else "a", k, float(t[k]), float("nan") if rng.random() < 0.4 else float(rng.normal())) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, t double, v double")
    steps = {r.i: r.dt for r in S.steps(df, "t", ["t"], ["k"]).collect()}
    filled = {r.i: r.v for r in S.fill(df, "v", "i", ["k"]).collect()}
    run = {r.i: r.running for r in S.running_mean(S.steps(df, "t", ["t"], ["k"]), F.lit(2.0), "t", ["t"], ["k"]).collect()}
    for key in (None, "a"):
        mine = [r for r in rows if r[0] == key]
        place, v = np.arange(len(mine)), np.array([r[3] for r in mine])
        want = np.interp(place, place[~np.isnan(v)], v[~np.isnan(v)])
        for n, (_, i, at, _) in enumerate(mine):
            assert abs(steps[i] - (at - (mine[n - 1][2] if n else 0.0))) < 1e-9 and abs(filled[i] - want[n]) < 1e-9 and abs(run[i] - 2.0) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 97, 256])
def test_long_series_are_transformed_in_parts(spark, n):
    y = np.random.default_rng(n).normal(size=n)
    rows = [("a", i, float(v)) for i, v in enumerate(y)] + [(None, i, float(v)) for i, v in enumerate(y[::-1])]
    df = G.sized(spark.createDataFrame(rows, "b string, i long, v double"), "b")
    for whole in (0, 1 << 18):
        got = {(r.b, r.k): complex(r.re, r.im) for r in G.fourier(df, "b", "i", "v", whole).collect()}
        for name, want in (("a", np.fft.rfft(y)), (None, np.fft.rfft(y[::-1]))):
            assert np.allclose([got.pop((name, k)) for k in range(len(want))], want)
        assert not got


def test_a_density_integrates_to_the_variance(spark):
    y = np.random.default_rng(3).normal(size=128)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "b string, i long, v double")
    got = G.fft_spectra(df, "b", "i", "v", 0.25).toPandas()
    assert np.isclose(got.power.sum() / (128 * 0.25), y.var())
    wave = df.withColumn("v", 3 * F.cos(2 * np.pi * F.col("i") / 8))
    tall = G.fft_spectra(wave, "b", "i", "v", 0.25, psd=False).orderBy(F.desc("power")).first()
    assert np.isclose(tall.power, 3) and np.isclose(tall.freq, 0.5)


def test_planes_of_points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) * (3, 2, 0.1) @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    rows = [("a", *map(float, r)) for r in x] + [("line", float(k), 2.0 * k, 0.0) for k in range(5)] + [("level", 1.0, float(k % 2), float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "b string, x double, y double, z double")
    got = {r.b: r for r in A.fitted_plane(df, ["b"], ["x", "y", "z"]).collect()}
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    want = vector[:, 0] * np.sign(vector[2, 0])
    assert np.allclose(got["a"].normal, want) and np.isclose(got["a"].rms, np.sqrt(value[0])) and got["line"].normal is None
    assert np.allclose(np.abs(got["level"].normal), [1, 0, 0]) and got["level"].normal[0] > 0
    far = A.plane_distance(df.where("b = 'a'"), ["b"], ["x", "y", "z"]).toPandas()
    assert np.allclose(far.distance, np.abs((far[["x", "y", "z"]].to_numpy() - x.mean(0)) @ want))


def test_gradients_on_tetrahedra_are_exact_for_linear_fields(spark):
    at = [(0.0, 0.0, 0.0), (1.0, 0.2, 0.0), (0.1, 1.0, 0.3), (0.0, 0.2, 2.0), (1.0, 1.0, 1.0)]
    nodes = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "node_id long, x double, y double, z double")
    elements = spark.createDataFrame([(0, 30, [0, 1, 2, 3]), (1, 30, [2, 1, 3, 4]), (2, 30, [0, 1, 1, 3])], "elem_id long, ltype int, nodes array<long>")
    f = nodes.select("node_id", F.expr("2 * x - y + 3 * z + 1").alias("f"), F.expr("5 * y").alias("g"), F.expr("z - x").alias("h"))
    got = M.solid_gradients(elements, nodes, f, ["f"]).collect()
    assert len(got) == 5 and all(np.allclose(r.f, [2, -1, 3]) for r in got)
    assert all(np.isclose(r.div, 2 + 5 + 1) for r in M.solid_divergence(elements, nodes, f, ["f", "g", "h"]).collect())


UNIT = {
    2: [(0, 0, 0), (2, 0, 0)], 10: [(0, 0, 0), (1, 0, 0), (0, 1, 1)], 12: [(0, 0, 0), (2, 0, 0), (2, 1, 0), (0, 1, 0)],
    30: [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], 32: [(-1, -1, 0), (1, -1, 0), (1, 1, 0), (-1, 1, 0), (0, 0, 1)],
    34: [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 2), (1, 0, 2), (0, 1, 2)],
    37: [(0, 0, 0), (2, 0, 0), (2, 1, 0), (0, 1, 0), (0.5, 0, 1), (1.5, 0, 1), (1.5, 1, 1), (0.5, 1, 1)],
}


@pytest.mark.parametrize(("ltype", "size"), [(2, 2), (10, 2**0.5 / 2), (12, 2), (30, 1 / 6), (32, 4 / 3), (34, 1), (37, 1.5)])
def test_integrals_of_every_element(spark, ltype, size):
    at = [tuple(map(float, p)) for p in UNIT[ltype]]
    nodes = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "node_id long, x double, y double, z double")
    elements = spark.createDataFrame([(0, ltype, [*range(len(at)), -1])], "elem_id long, ltype int, nodes array<long>")
    mass = {r.node_id: r.mass for r in M.lumped_mass(elements, nodes).collect()}
    assert np.isclose(sum(mass.values()), size)
    full = M.consistent_mass(elements, nodes).toPandas().pivot(index="i", columns="j", values="v").to_numpy()
    assert np.allclose(full, full.T) and np.allclose(full.sum(1), [mass[k] for k in range(len(at))]) and np.linalg.eigvalsh(full)[0] > 0
    field = nodes.withColumn("f", F.expr("1 + 2 * x + 3 * y - z")).withColumn("far", F.lit(ltype != 2))
    want = sum(m * (1 + 2 * p[0] + 3 * p[1] - p[2]) for m, p in zip((mass[k] for k in range(len(at))), at, strict=True))
    assert np.isclose(M.integral(elements, nodes, field, "f").first().integral, want)
    assert np.isclose(M.integral(elements, nodes, field, "f", "far").first().integral, want if ltype != 2 else 0)
    along = {2: (2, 0, 0), 10: (2, 1, 1), 12: (2, 3, 0)}.get(ltype, (2, 3, -1))  # the part within the line or surface
    assert all(np.allclose((r.gx, r.gy, r.gz), along) for r in M.nodal_gradients(elements, nodes, field, "f").collect())


@pytest.mark.parametrize("n,percent", [(0, 30), (1, 0), (1, 100), (500, 37.3), (500, 100), (500, 0)])
def test_thinning_keeps_the_lowest_hashes(spark, n, percent):
    from aerospan.operators import polygons as P

    df = spark.range(n).withColumn("v", F.col("id") % 7)
    keep = n - int(n * percent / 100)
    want = {r.id for r in df.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(keep).collect()}
    rows = [r.id for r in P.thinned(df, percent, "id", 3).collect()]
    assert len(rows) == keep and set(rows) == want


def test_rings_across_a_bay_are_not_part_of_it(spark):
    from aerospan.operators import regions as R

    rows = {1: [(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)], 2: [(1, 6), (8, 6), (8, 7), (1, 7)], 3: [(1, 1), (8, 1), (8, 2), (1, 2)], 4: [(20, 20), (21, 20), (21, 21)]}
    rings = spark.createDataFrame([(k, n, float(x), float(y)) for k, v in rows.items() for n, (x, y) in enumerate(v)], "id long, pt_no int, x double, y double")
    assert [tuple(r) for r in R.part_of(rings.where("id > 1"), rings.where("id = 1")).collect()] == [(3, 1)]
