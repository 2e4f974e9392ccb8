"""The fast grid of Lomb-Scargle powers against direct sums."""

import numpy as np
import pytest

from aerospan.operators import signals as G


def direct(t, y, freqs):
    out, y = [], y - y.mean()
    for f in freqs:
        a = 2 * np.pi * f * (t - t[0])
        shift = np.arctan2(np.sin(2 * a).sum(), np.cos(2 * a).sum()) / 2
        c, s = np.cos(a - shift), np.sin(a - shift)
        out.append(((y @ c) ** 2 / (c @ c) + ((y @ s) ** 2 / (s @ s) if s @ s > 1e-9 * len(t) else 0)) / 2)
    return np.array(out) / y.var(ddof=1)


@pytest.mark.parametrize("ofac,hifac,whole", [(4.0, 1.0, 1 << 20), (2.5, 2.0, 1 << 20), (4.0, 1.0, 0)])
def test_grid_against_direct_sums(spark, ofac, hifac, whole):
    """Uneven and even times, repeated times, large offsets, gaps; also with transforms dealt over tasks."""
    rng = np.random.default_rng(8)
    times = {"uneven": np.sort(rng.random(90) * 50) + 1e6, "even": np.arange(40.0), "gap": np.concatenate([rng.random(30), 1e4 + rng.random(31)]), None: np.repeat(rng.random(10), 3)}
    series = {k: (t, np.sin(0.7 * t) + rng.normal(size=len(t)) * 2 + 30) for k, t in times.items()}
    if whole == 0:
        series = {"uneven": series["uneven"]}
    rows = [(k, float(a), float(b)) for k, (t, y) in series.items() for a, b in zip(t, y, strict=True)]
    rows += [("uneven", float("nan"), 1.0), ("uneven", 3.0, None), ("one time", 1.0, 2.0), ("one time", 1.0, 3.0), ("flat", 1.0, 2.0), ("flat", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "name string, t double, y double")
    got = {}
    for r in G.lomb_grid(df, "name", "t", "y", ofac, hifac, whole).collect():
        got.setdefault(r.name, {})[r.k] = (r.freq, r.power)
    assert set(got) == set(series)
    for name, (t, y) in series.items():
        at = np.argsort(t, kind="stable")
        t, y = t[at], y[at]
        top = int(0.5 * ofac * hifac * len(t))
        assert sorted(got[name]) == list(range(1, top + 1))
        freqs = np.arange(1, top + 1) / (ofac * (t[-1] - t[0]))
        assert [got[name][k + 1][0] for k in range(top)] == pytest.approx(freqs.tolist())
        assert np.abs(np.array([got[name][k + 1][1] for k in range(top)]) - direct(t, y, freqs)).max() < 1e-6 * max(1, len(t) / 10)
    assert G.lomb_grid(df.where("false"), "name", "t", "y").count() == 0
