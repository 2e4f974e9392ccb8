"""Arrangements, triangles and solids against known rings, parity of points, and areas."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospan.operators import arrangement as A
from aerospan.operators import triangulation as T

SQUARE = [(0, 0), (8, 0), (8, 8), (0, 8)]
#: Rings, and what they are as valid polygons: outer ring first, each from its least vertex, sorted.
CASES = {
    "square": ([SQUARE], [[SQUARE]]),
    "other way round": ([SQUARE[::-1]], [[SQUARE]]),
    "nothing": ([[(0, 0), (3, 3)], [(5, 5)], [(1, 1), (1, 1)]], []),
    "there and back": ([[(0, 0), (4, 4), (0, 0), (4, 4)]], []),
    "crossed": ([[(0, 0), (4, 4), (4, 0), (0, 4)]], [[[(0, 0), (2, 2), (0, 4)]], [[(2, 2), (4, 0), (4, 4)]]]),
    "spikes": ([[(0, 0), (12, 3), (0, 0), (8, 0), (8, 8), (6, 8), (6, 11), (6, 8), (0, 8)]], [[SQUARE]]),
    "collinear": ([[(0, 0), (4, 0), (6, 0), (8, 0), (8, 5), (8, 8), (0, 8)]], [[SQUARE]]),
    "same edge in part": ([SQUARE, [(8, 0), (11, 0), (11, 5), (8, 5)]], [[[(0, 0), (11, 0), (11, 5), (8, 5), (8, 8), (0, 8)]]]),
    "twice": ([SQUARE, SQUARE], []),
    "hole": ([SQUARE, [(2, 2), (5, 2), (5, 6), (2, 6)]], [[SQUARE, [(2, 2), (2, 6), (5, 6), (5, 2)]]]),
    "hole meets a corner": ([SQUARE, [(0, 8), (2, 2), (6, 6)]], [[SQUARE, [(0, 8), (6, 6), (2, 2)]]]),
    "hole meets two corners": ([SQUARE, [(8, 0), (6, 6), (0, 8), (2, 2)]], [[[(0, 0), (8, 0), (2, 2), (0, 8)]], [[(0, 8), (6, 6), (8, 0), (8, 8)]]]),
    "hole meets an edge": ([SQUARE, [(2, 2), (6, 2), (4, 8)]], [[[(0, 0), (8, 0), (8, 8), (4, 8), (0, 8)], [(2, 2), (4, 8), (6, 2)]]]),
    "crossing bars": ([[(0, 3), (9, 3), (9, 6), (0, 6)], [(3, 0), (6, 0), (6, 9), (3, 9)]], [[[(0, 3), (3, 3), (3, 6), (0, 6)]], [[(3, 0), (6, 0), (6, 3), (3, 3)]], [[(3, 6), (6, 6), (6, 9), (3, 9)]], [[(6, 3), (9, 3), (9, 6), (6, 6)]]]),
    "island in a hole": ([SQUARE, [(1, 1), (7, 1), (7, 7), (1, 7)], [(2, 2), (4, 2), (4, 4), (2, 4)], [(5, 5), (6, 5), (6, 6), (5, 6)]], [[SQUARE, [(1, 1), (1, 7), (7, 7), (7, 1)]], [[(2, 2), (4, 2), (4, 4), (2, 4)]], [[(5, 5), (6, 5), (6, 6), (5, 6)]]]),
    "holes above each other": ([SQUARE, [(1, 1), (3, 1), (3, 2), (1, 2)], [(2, 4), (3, 4), (3, 5), (2, 5)], [(2.5, 6), (3, 6), (3, 7), (2.5, 7)]], [[SQUARE, [(1, 1), (1, 2), (3, 2), (3, 1)], [(2, 4), (2, 5), (3, 5), (3, 4)], [(2.5, 6), (2.5, 7), (3, 7), (3, 6)]]]),
}


def table(spark, polygons):
    """{id: rings} as a vertex table with an extra column."""
    rows = [(i, r, k, float(x), float(y), "x") for i, rings in polygons.items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "id string, ring int, pt_no int, x double, y double, face string")


def collected(rings):
    out = defaultdict(lambda: defaultdict(dict))
    for r in sorted(rings.collect()):
        out[r.id][r.polygon].setdefault(r.ring, []).append((r.x, r.y))
    return out


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def inside(p, rings):
    n = 0
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
    return n % 2 == 1


@pytest.fixture(scope="module")
def wild():
    """Random rings that cross themselves and each other, one of them with many edges, on whole and on real coordinates."""
    rng = np.random.default_rng(5)
    out = {f"whole {k}": [rng.integers(0, 12, (n, 2)).tolist() for n in rng.integers(3, 12, 2)] for k in range(6)}
    out |= {f"real {k}": [(rng.random((n, 2)) * 12).tolist() for n in rng.integers(3, 12, 2)] for k in range(4)}
    out["many"] = [(rng.random((5, 2)) + rng.integers(0, 11, 2)).tolist() for _ in range(60)]
    return {k: [list(map(tuple, r)) for r in rings] for k, rings in out.items()}


def test_known_repairs(spark):
    got = collected(A.repaired(table(spark, {k: v[0] for k, v in CASES.items()})))
    for name, (_, want) in CASES.items():
        found = sorted([ring for _, ring in sorted(p.items())] for p in got.get(name, {}).values())
        assert found == sorted([[tuple(map(float, v)) for v in ring] for ring in p] for p in want), name


def test_empty_tables(spark):
    none = table(spark, {"square": [SQUARE]}).where("false")
    assert A.repaired(none).count() == 0 and T.triangulated(A.repaired(none)).count() == 0


def test_repairs_and_triangles_of_wild_rings(spark, wild):
    rings = A.repaired(table(spark, wild)).cache()
    got, rng = collected(rings), np.random.default_rng(6)
    for name, source in wild.items():
        for polygon in got[name].values():
            assert area(polygon[0]) > 0 and all(area(r) < 0 for k, r in polygon.items() if k)
            assert all(len(set(r)) == len(r) and r[0] == min(r) for r in polygon.values())
        flat = [r for p in got[name].values() for r in p.values()]
        for p in rng.random((200, 2)) * 12:
            assert inside(p, flat) == inside(p, source), name
    total, count = Counter(), Counter()
    for t in T.triangulated(rings).collect():
        a = ((t.bx - t.ax) * (t.cy - t.ay) - (t.by - t.ay) * (t.cx - t.ax)) / 2
        flat = [r for p in got[t.id].values() for r in p.values()]
        corners = {v for r in flat for v in r}
        assert a > 0 and {(t.ax, t.ay), (t.bx, t.by), (t.cx, t.cy)} <= corners
        if a > 1e-6:
            assert inside(((t.ax + t.bx + t.cx) / 3, (t.ay + t.by + t.cy) / 3), flat)
        total[t.id] += a
        count[t.id] += 1
    for name, polygons in got.items():
        flat = [r for p in polygons.values() for r in p.values()]
        assert total[name] == pytest.approx(sum(map(area, flat)), abs=1e-7)
        assert count[name] <= sum(map(len, flat)) + 2 * sum(len(p) - 1 for p in polygons.values()) - 2 * len(polygons)


def test_booleans_of_wild_rings(spark, wild):
    names = [n for n in wild if n != "many"]
    a, b = {n: wild[n][:1] for n in names}, {n: wild[n][1:] for n in names} | {"only b": [SQUARE]}
    rng = np.random.default_rng(7)
    for rule in ("join", "intersection", "difference"):
        got = collected(A.overlaid(table(spark, a), table(spark, b), rule))
        want = {"join": lambda p, q: p or q, "intersection": lambda p, q: p and q, "difference": lambda p, q: p and not q}[rule]
        for n in [*names, "only b"]:
            flat = [r for p in got[n].values() for r in p.values()] if n in got else []
            for p in rng.random((150, 2)) * 12:
                assert inside(p, flat) == want(inside(p, a.get(n, [])), inside(p, b[n])), (rule, n)


def test_complement(spark):
    got = collected(A.complement(table(spark, {"a": [SQUARE, [(2, 2), (5, 2), (5, 6), (2, 6)], [(20, 0), (21, 0), (21, 1)]]})))["a"]
    assert sorted(area(r) for r in got[-1].values()) == [-64, -0.5] and [area(r) for r in got[0].values()] == [12]


def test_solids_are_closed(spark):
    """Every edge of a raised solid is walked once each way, and the volume is area times height."""
    rings = A.repaired(table(spark, {"a": [SQUARE, [(2, 2), (5, 2), (5, 6), (2, 6)]], "b": [[(0, 0), (5, 0), (5, 5), (4, 1), (1, 1), (0, 5)]]}))
    h = spark.createDataFrame([("a", 1.0, 4.0), ("b", -1.0, 1.0)], "id string, base double, top double")
    walked, volume = defaultdict(Counter), Counter()
    for r in T.raised(rings, h).collect():
        p = [tuple(v) for v in r.p]
        volume[r.id] += np.linalg.det(np.array(p)) / 6
        for k in range(3):
            walked[r.id][p[k], p[(k + 1) % 3]] += 1
    assert volume["a"] == pytest.approx(52 * 3) and volume["b"] == pytest.approx(2 * abs(area([(0, 0), (5, 0), (5, 5), (4, 1), (1, 1), (0, 5)])))
    for edges in walked.values():
        assert all(n == 1 and edges[b, a] == 1 for (a, b), n in edges.items())
    assert T.raised(rings, h).where(F.col("part") == "wall").count() == 2 * (8 + 6)


def test_texts_keep_their_polygons(spark):
    """Texts of several polygons are read polygon by polygon, repaired, and written again."""
    from aerospan.sources import text

    rows = [("two", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1)), ((6 0,7 0,7 1.5,6 0)))"), ("one", "polygon((0 0,1 0,1 1))"), ("none", "MULTIPOLYGON EMPTY"), ("other", "POINT(1 2)")]
    df = spark.createDataFrame(rows, "id string, wkt string").withColumn("m", text.wkt_multipolygon(F.col("wkt")))
    assert {r.id: r.n for r in df.select("id", F.transform("m", lambda p: F.size(p)).alias("n")).collect()} == {"two": [2, 1], "one": [1], "none": [], "other": None}
    each = df.select("id", F.posexplode("m").alias("polygon", "_r")).select("id", "polygon", F.posexplode("_r").alias("ring", "_v")).select("id", "polygon", "ring", F.posexplode(text.closed(F.col("_v"))).alias("pt_no", "_p"))
    rings = each.select("id", F.struct("polygon", "ring").alias("ring"), "pt_no", "_p.x", "_p.y")
    got = {r.id: r.wkt for r in text.multipolygon_text(A.repaired(rings)).collect()}
    assert got == {"two": "MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1)),((6 0,7 0,7 1.5,6 0)))", "one": "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))"}


def test_cycles_close_within_tasks_or_go_on(spark, monkeypatch):
    """The same places on cycles, whether a task holds all links of an id or a few, and without rounds over all links where it does."""
    rng, rows, h = np.random.default_rng(4), [], 0
    for i, size in enumerate((1, 2, 3, 40, 7, 100, 5)):
        around = rng.permutation(size).tolist()
        rows += [(i, h + around[k], h + around[(k + 1) % size], int(rng.integers(0, 5)), int(rng.integers(0, 5))) for k in range(size)]
        h += size
    links = spark.createDataFrame(rows, "id long, h long, nxt long, ox long, oy long").repartition(3, "id")
    want = {r.h: (r.cycle, r.pos, r.n) for r in A.traced(links).collect()}
    rounds, traced = [], A.traced
    monkeypatch.setattr(A, "traced", lambda left: rounds.append(left.count()) or traced(left))
    assert {r.h: (r.cycle, r.pos, r.n) for r in A.cycles(links).collect()} == want and rounds == []
    monkeypatch.setattr(A, "LARGE", 8)
    few = spark.createDataFrame(rows, "id long, h long, nxt long, ox long, oy long").repartition(5, "h")
    assert {r.h: (r.cycle, r.pos, r.n) for r in A.cycles(few).collect()} == want and len(rounds) == 1
    assert {r.id: r._many for r in A.crowded(links).collect()} == {3: 5, 5: 13}


def test_outlines_of_crowded_ids(spark, monkeypatch):
    """An id with more links than a task takes is dealt over tasks, with the same rings."""
    rng = np.random.default_rng(8)
    rings = spark.createDataFrame([(i, 0, k, float(x), float(y)) for i, n in ((1, 30), (2, 4)) for k, (x, y) in enumerate(rng.random((n, 2)))], "id long, ring int, pt_no int, x double, y double")
    want = sorted(map(tuple, A.repaired(rings).collect()))
    monkeypatch.setattr(A, "LARGE", 16)
    assert sorted(map(tuple, A.repaired(rings).collect())) == want


def test_small_outlines_are_listed_in_one_cell(spark):
    """Segments of a small id are not copied to many cells, those of a large one lie in a grid."""
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]
    round_ = [(9 * np.cos(k / 100), 9 * np.sin(k / 100)) for k in range(600)]
    s = spark.createDataFrame([(i, k, *map(int, (1e9 * x, 1e9 * y, 1e9 * u, 1e9 * v))) for i, ring in ((1, square), (2, round_)) for k, ((x, y), (u, v)) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))], "id long, s long, ax long, ay long, bx long, by long")
    turned = s.selectExpr("id", "s", "least(ax, bx) ax", "if(ax <= bx, ay, by) ay", "greatest(ax, bx) bx", "if(ax <= bx, by, ay) by")
    listed = A._listed(turned).collect()
    assert sum(r.id == 1 for r in listed) == 4
    assert len({(r.c, r.r) for r in listed if r.id == 2}) > 10 and {r.s for r in listed if r.id == 2} == set(range(600))
