"""Queries over whole tables against brute force, on ids and lengths beyond the cuts of the SQL of their older namesakes."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from aerospan import catalogue
from aerospan.operators.polygons import in_contact

IDS = [*range(190, 206), *range(495, 506), *range(995, 1020), *range(1_000_001, 1_000_012)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("whole"), np.random.default_rng(12)
    pq.write_table(pa.table({"p_partkey": pa.array(IDS, pa.int64()), "p_size": pa.array(rng.integers(1, 51, len(IDS)), pa.int32()), "p_retailprice": np.round(900 + rng.random(len(IDS)) * 30, 2)}), at / "part.parquet")
    pq.write_table(pa.table({"o_orderkey": pa.array(range(80), pa.int64()), "o_totalprice": np.round(90_000 + rng.random(80) * 3500, 2)}), at / "orders.parquet")
    n, start = 301, dt.datetime(2024, 1, 1)
    types = ["a" if k % 3 else "b" for k in range(n)]
    ts = [start + dt.timedelta(seconds=int(x)) for x in np.sort(rng.integers(0, 900_000, n))]
    pq.write_table(pa.table({"event_id": pa.array(range(n), pa.int64()), "event_type": types, "ts": pa.array(ts, pa.timestamp("us")), "value": rng.normal(size=n)}), at / "events.parquet")
    return str(at)


def rows(spark, folder, name):
    return [tuple(r) for r in catalogue.queries()[name](spark, folder).collect()]


def parts(folder):
    t = pq.read_table(f"{folder}/part.parquet").to_pydict()
    return list(zip(t["p_partkey"], t["p_size"], t["p_retailprice"], strict=True))


@pytest.mark.parametrize("name, lt", [("box_overlap_closed_all", np.less_equal), ("box_overlap_half_open_all", np.less)])
def test_boxes(spark, folder, name, lt):
    p = parts(folder)
    want = {(i, j) for i, s, y in p for j, t, z in p if lt(s, t + 2) and lt(t, s + 2) and lt(y, z + 5) and lt(z, y + 5)}
    got = rows(spark, folder, name)
    assert len(got) == len(want) and set(got) == want and max(got)[0] > 1_000_000


def test_neighbours(spark, folder):
    p = {i: s for i, s, _ in parts(folder)}
    both = sorted((i, i + 1, float(max(s, p[i + 1])), min(s, p[i + 1]) + 2.0) for i, s in p.items() if i + 1 in p and abs(s - p[i + 1]) <= 2)
    assert sorted(rows(spark, folder, "box_intersection_all")) == both
    assert sorted(rows(spark, folder, "polygons_touching_all")) == [(i, i + 1) for i, s in p.items() if i + 1 in p and s >= 20]


def test_stabs(spark, folder):
    o = pq.read_table(f"{folder}/orders.parquet").to_pydict()
    want = {(k, i) for k, v in zip(o["o_orderkey"], o["o_totalprice"], strict=True) for i, s, y in parts(folder) if y * 100 < v <= y * 100 + s * 10}
    got = rows(spark, folder, "interval_stab_all")
    assert len(got) == len(want) and set(got) == want and any(i > 500 for _, i in got)


def test_spectra_read_every_sample(spark, folder):
    e = pq.read_table(f"{folder}/events.parquet").to_pydict()
    got, lomb = rows(spark, folder, "periodogram_all"), rows(spark, folder, "lomb_scargle_all")
    for kind in "ab":
        at = [k for k, x in enumerate(e["event_type"]) if x == kind]
        v, t = np.array(e["value"])[at], np.array([(e["ts"][k] - dt.datetime(2024, 1, 1)).total_seconds() / 3600 for k in at])
        n = len(v)
        assert n > 64
        want = [abs(np.sum(v * np.exp(-2j * np.pi * k * np.arange(n) / n))) ** 2 / n for k in range(n // 2 + 1)]
        assert np.allclose([p for _, _, p in sorted(r for r in got if r[0] == kind)], want, atol=6e-4)
        for x, freq, power in lomb:
            if x == kind:
                y, a = v - v.mean(), 2 * np.pi * freq * t
                a = a - np.arctan2(np.sin(2 * a).sum(), np.cos(2 * a).sum()) / 2
                c, s = np.cos(a), np.sin(a)
                assert abs(power - ((y @ c) ** 2 / (c @ c) + (y @ s) ** 2 / (s @ s)) / 2 / v.var(ddof=1)) < 2e-5
    assert len(lomb) == 8


def test_touching_from_id_zero(spark, tmp_path):
    """Ring 0 and the moved ring 0 have ids of their own."""
    size = [10, 30, 19, 25, 20]
    pq.write_table(pa.table({"p_partkey": pa.array(range(5), pa.int64()), "p_size": pa.array(size, pa.int32())}), tmp_path / "part.parquet")
    assert sorted(rows(spark, str(tmp_path), "polygons_touching_all")) == [(1, 2), (3, 4)]


def test_contact_of_given_pairs(spark):
    """A ring within the other one, either way round, and rings apart; pairs that are not given have no row."""
    square = lambda i, a, b: [(i, k, float(x), float(y)) for k, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    rings = spark.createDataFrame(square(1, 0, 10) + square(2, 3, 4) + square(3, 20, 21) + square(4, 6, 7), "id long, pt_no int, x double, y double")
    pairs = spark.createDataFrame([(1, 2), (4, 1), (1, 3), (2, 4)], "id long, other long")
    assert sorted(tuple(r) for r in in_contact(rings, pairs).collect()) == [(1, 2), (4, 1)]
