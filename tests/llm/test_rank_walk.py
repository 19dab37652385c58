from __future__ import annotations

import numpy as np

from reelgrid.llm.rank_walk import rank_walk, stationary


def dense_walk(place, damping, rounds=400):
    n, m = place.shape
    t = np.zeros((n, n))
    for j in range(m):
        for i in range(n):
            up = np.flatnonzero(place[:, j] > place[i, j])
            t[i, up] += 1 / (len(up) + 1) / m
            t[i, i] += 1 / (len(up) + 1) / m
    p = np.full(n, 1 / n)
    for _ in range(rounds):
        p = (1 - damping) / n + damping * p @ t
    return p


def test_prefix_sums_equal_the_dense_chain():
    v = np.random.default_rng(3).integers(0, 9, size=(25, 4)).astype(float)
    assert np.allclose(stationary(v, 0.7, 500), dense_walk(v, 0.7))


def test_scale_does_not_matter_and_no_score_decides():
    r = np.random.default_rng(4)
    v = r.random((40, 3))
    v[7] = v.max(0) + 0.01
    v[9, 0] = 50.0
    w = v * [1e6, 1e-3, 1] + [0, 5, -3]
    assert np.allclose(stationary(v), stationary(w))
    assert stationary(v).argmax() == 7


def test_missing_is_neutral():
    v = np.tile(np.linspace(0, 1, 30)[:, None], (1, 4))
    v[20, 2] = np.nan
    assert np.argsort(-stationary(v))[9] == 20


def test_operator(spark):
    rows = [(1, "a", [9.0, 0.9]), (1, "a", [9.0, 0.9]), (1, "b", [1.0, 0.5]), (1, "c", [1.0, 0.5]), (1, "d", None), (1, "e", [None, 0.1]), (1, None, [1.0]), (None, "x", [1.0]), (2, "z", []), (3, "q", [float("nan")])]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "q int, i string, s array<double>, g string, place int")
    got = {(r.q, r.i): r.place for r in rank_walk(df, "q", "i", "s").collect()}
    assert got[(1, "a")] == 1 and got[(1, "b")] + 1 == got[(1, "c")]
    assert got[(2, "z")] == 1 and got[(3, "q")] == 1 and len(got) == 7
    assert rank_walk(df.limit(0), "q", "i", "s").collect() == []


def test_large_groups_over_the_cluster_equal_one_task(spark):
    r = np.random.default_rng(6)
    rows = []
    for q, n in ((1, 160), (2, 12)):
        v = np.round(r.random((n, 3)) * 20)
        v[r.random((n, 3)) < 0.1] = np.nan
        rows += [(q, f"i{k:03d}", [None if np.isnan(x) else float(x) for x in v[k]]) for k in range(n)]
    df = spark.createDataFrame(rows, "q int, i string, s array<double>")
    one = {(x.q, x.i): (x.place, x.mass) for x in rank_walk(df, "q", "i", "s").collect()}
    far = {(x.q, x.i): (x.place, x.mass) for x in rank_walk(df, "q", "i", "s", group_rows=50).collect()}
    assert one.keys() == far.keys()
    assert max(abs(one[k][1] - far[k][1]) for k in one) < 1e-8
    top = lambda d: [k for k in sorted(d, key=lambda k: d[k][0]) if k[0] == 1][:20]
    assert top(one) == top(far)
    assert sorted(p for (q, _), (p, _) in far.items() if q == 1) == list(range(1, 161))
