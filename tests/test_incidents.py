"""Sequential incident operators against plain loops."""

import numpy as np

from helioscope.operators import incidents


def brute_splits(x, min_size, penalty, effect):
    place = [i for i, r in enumerate(x) if np.isfinite(r).all()]
    z = np.array([x[i] for i in place], float)
    if len(z) < 2 * min_size:
        return []
    z = (z - z.mean(0)) / np.where(z.std(0) == 0, 1, z.std(0))
    error = lambda a, b: ((z[a:b] - z[a:b].mean(0)) ** 2).sum()

    def cut(a, b):
        saved = [(error(a, b) - error(a, k) - error(k, b), -k) for k in range(a + min_size, b - min_size + 1)]
        if not saved:
            return []
        most, k = max(saved)
        k = -k
        if most <= penalty or np.abs(z[a:k].mean(0) - z[k:b].mean(0)).max() < effect:
            return []
        return cut(a, k) + [k] + cut(k, b)

    return [place[k] for k in cut(0, len(z))]


def test_split_points():
    r = np.random.default_rng(4)
    for trial in range(40):
        x = r.normal(size=(60, 2)) + np.repeat(r.normal(scale=3, size=(4, 2)), 15, 0)
        x[r.integers(0, 60, 3)] = np.nan
        got = incidents.split_points(x, 4, 2.0 * np.log(60), 0.8)
        assert got == brute_splits(x, 4, 2.0 * np.log(60), 0.8)
    assert incidents.split_points(np.ones((30, 1)), 3, 0.0, 0.0) == []
    assert incidents.split_points(np.empty((0, 2)), 3, 0.0, 0.0) == []


def test_change_points_and_peaks(spark):
    rows = [("a", t, 10 * (t >= 20) + t % 2, (t * 7) % 13) for t in range(40)] + [("b", t, None, t % 3) for t in range(9)]
    df = spark.createDataFrame(rows, "m string, t int, x int, s int").repartition(3)
    assert [tuple(r) for r in incidents.change_points(df, ["m"], "t", ["x"]).collect()] == [("a", 20)]
    want = []
    for m in "ab":
        kept = []
        for s, t in sorted(((r[3], r[1]) for r in rows if r[0] == m), reverse=True):
            if all(abs(t - k) >= 4 for k in kept):
                kept.append(t)
                want.append((m, t, s))
    assert sorted(map(tuple, incidents.spaced_peaks(df, ["m"], "t", "s", 4).collect())) == sorted(want)
    assert incidents.spaced_peaks(df.limit(0), ["m"], "t", "s", 4).count() == 0
