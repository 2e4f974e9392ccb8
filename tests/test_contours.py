"""Contour lines against a walk by hand, rings of a cone, ties at nodes, open and closed lines, and skylines against a sweep."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aerospan.operators import contours as C
from aerospan.operators import shadows as S


def plane(spark, n, f, step=1.0):
    """A square of n cells a side, cut into triangles, with values f(x, y)."""
    at = lambda i, j: i + j * (n + 1)
    nodes = [(at(i, j), i * step, j * step, 0.0, float(f(i * step, j * step))) for i in range(n + 1) for j in range(n + 1)]
    tris = [t for i in range(n) for j in range(n) for t in ([at(i, j), at(i + 1, j), at(i + 1, j + 1)], [at(i, j), at(i + 1, j + 1), at(i, j + 1)])]
    rows = spark.createDataFrame(nodes, "node_id long, x double, y double, z double, f double")
    return spark.createDataFrame([(k, 10, t) for k, t in enumerate(tris)], "elem_id long, ltype int, nodes array<long>"), rows, tris, nodes


def walked(tris, nodes, level):
    """Lines as sets of edges, by following neighbours one by one."""
    f = {n[0]: n[4] for n in nodes}
    links = {}
    for t in tris:
        met = [tuple(sorted((t[k], t[(k + 1) % 3]))) for k in range(3) if (f[t[k]] >= level) != (f[t[(k + 1) % 3]] >= level)]
        if met:
            for a, b in (met, met[::-1]):
                links.setdefault(a, set()).add(b)
    lines, left = [], set(links)
    while left:
        line, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            line.add(p)
            todo += links[p] - line
        left -= line
        lines.append((frozenset(line), all(len(links[p]) == 2 for p in line)))
    return set(lines), links


def test_lines_of_noise(spark):
    rng = random.Random(3)
    value = {}
    elements, rows, tris, nodes = plane(spark, 9, lambda x, y: value.setdefault((x, y), rng.randrange(6)))  # many nodes at a level
    got = C.contour_lines(elements, rows, rows, "f", [2.0, 3.5]).collect()
    for level in (2.0, 3.5):
        want, links = walked(tris, nodes, level)
        lines = {}
        for r in got:
            if r.level == level:
                lines.setdefault((r.line, r.closed), {})[r.pt_no] = (r.lo, r.hi)
        assert {(frozenset(v.values()), c) for (_, c), v in lines.items()} == want
        for (_, closed), line in lines.items():
            points = [line[k] for k in range(len(line))]  # numbered without gaps
            assert len(set(points)) == len(points)
            assert all(b in links[a] for a, b in zip(points, points[1:], strict=False))
            assert not closed or points[0] in links[points[-1]]


def test_rings_of_a_cone(spark):
    elements, rows, *_ = plane(spark, 40, lambda x, y: 1 - math.hypot(x - 1, y - 1), 0.05)
    lines = C.contour_lines(elements, rows, rows, "f", [0.3, 0.6, -0.2, 7.0])
    got = {(r.level, r.closed): r for r in C.lengths(lines).collect() if r.level > 0}
    assert set(got) == {(0.3, True), (0.6, True)}
    assert got[0.3, True].length == pytest.approx(2 * math.pi * 0.7, rel=5e-3)
    assert got[0.6, True].length == pytest.approx(2 * math.pi * 0.4, rel=5e-3)
    open_lines = [r for r in C.lengths(lines.where("level < 0")).collect()]
    arc = 4 * 1.2 * (math.pi / 2 - 2 * math.acos(1 / 1.2))
    assert len(open_lines) == 4 and not any(r.closed for r in open_lines) and sum(r.length for r in open_lines) == pytest.approx(arc, rel=1e-2)
    ring = sorted((r.pt_no, r.x, r.y) for r in lines.where("level = 0.6").collect())
    area = sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
    assert area == pytest.approx(math.pi * 0.16, rel=1e-2)  # the top is on the left


def test_awkward_meshes(spark):
    elements, rows, *_ = plane(spark, 2, lambda x, y: x)
    assert C.contour_lines(elements.where("false"), rows, rows, "f", [0.5]).count() == 0
    assert C.contour_lines(elements, rows, rows, "f", [5.0]).count() == 0
    flat = C.lengths(C.contour_lines(elements, rows, rows.withColumn("f", F.when(F.col("node_id") == 0, None).otherwise(F.col("f"))), "f", [1.0])).collect()
    assert [(round(r.length, 9), r.closed) for r in flat] == [(1.0, False)]  # nodes at the level; the cell without a value is left out
    # three triangles at one edge: lines end there
    fan = spark.createDataFrame([(k, 10, [0, 1, 2 + k]) for k in range(3)], "elem_id long, ltype int, nodes array<long>")
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 0.0), (3, 0.0, -1.0, 0.0, 0.0), (4, 0.0, 0.0, 1.0, 0.0)], "node_id long, x double, y double, z double, f double")
    ends = C.contour_lines(fan, at, at, "f", [0.5])
    assert ends.select("line").distinct().count() == 3 and ends.count() == 6


def test_skylines(spark):
    rng = random.Random(5)
    rows = [(k, float(a), float(a + rng.randrange(0, 9) ** 2), float(rng.randrange(-1, 6))) for k, a in ((k, rng.randrange(60)) for k in range(150))]
    rows += [(500 + k, 0.0, 200.0, 0.5) for k in range(50)]  # many that are equal, over all
    got = {(r.lo, r.hi): r.height for r in S.skyline(spark.createDataFrame(rows, "id long, lo double, hi double, height double")).collect()}
    cuts = sorted({e for _, a, b, h in rows if a < b and h > 0 for e in (a, b)})
    want = {(p, q): max((h for _, a, b, h in rows if a <= p and q <= b), default=0.0) for p, q in zip(cuts, cuts[1:], strict=False)}
    assert got == {k: h for k, h in want.items() if h > 0}
    empty = spark.createDataFrame([], "id long, lo double, hi double, height double")
    assert S.skyline(empty).count() == 0


def test_blockage_ratio(spark):
    box = lambda k, x0, y0, x1, y1: [(k, n, float(x), float(y)) for n, (x, y) in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1)))]
    rings = spark.createDataFrame(box(1, 0, 0, 4, 2) + box(2, 10, 1, 12, 3) + box(3, 5, 9, 6, 14), "id long, pt_no int, x double, y double")
    heights = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 50.0)], "id long, height double")
    domain = spark.createDataFrame(box(0, -10, -10, 20, 10), "id long, pt_no int, x double, y double")
    r = S.blockage_ratio(rings, heights, domain, 20.0, 0.0).first()
    # the first two overlap between 1 and 2; the third is cut at the domain's side and top
    assert (r.area, r.section) == pytest.approx((2 * 5 + 1 * 3 + 1 * 20, 20 * 20)) and r.ratio == pytest.approx(33 / 400)
    assert S.blockage_ratio(rings.where("false"), heights, domain, 20.0, 30.0).first().ratio == 0.0
