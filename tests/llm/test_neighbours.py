from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reelgrid.llm.neighbours import similar_vectors

SCHEMA = "p bigint, v array<float>, id string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(p, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for p, v in rows], SCHEMA)


def brute(ids, x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for i, a in enumerate(ids):
        s = u @ u[i]
        same = (x == x[i]).all(1)
        s[same] = 1.0
        s[ids == a] = -9
        order = np.lexsort((ids, -s))[:k]
        out[a] = [ids[j] for j in order if s[j] >= least]
    return out


def test_recall_over_learned_parts(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 16))
    x = (centres[r.integers(60, size=3000)] + 0.15 * r.normal(size=(3000, 16))).astype(np.float32) * r.uniform(0.1, 30, size=(3000, 1)).astype(np.float32)
    ids = np.arange(3000) * 3
    got = {}
    df = frame(spark, zip(ids.tolist(), x.tolist()))
    for row in similar_vectors(df.union(df.limit(50)), "p", "v", k=10, dim=16, probes=3, sample_rows=1500, part_rows=200, block_rows=150).collect():
        got.setdefault(row.point_a, []).append(row.point_b)
    want = brute(ids, x, 10, -1)
    assert all(len(set(v)) == len(v) <= 10 for v in got.values())
    assert np.mean([len(set(got[a]) & set(w)) / len(w) for a, w in want.items()]) >= 0.9


def test_copies_get_their_nearest_copies(spark):
    rows = [(i, [1, 0, 0]) for i in range(40)] + [(100, [1, 0.1, 0]), (101, [0, 0, 1])]
    got = {}
    for r in similar_vectors(frame(spark, rows), "p", "v", k=3, dim=3, least_cosine=0.5).orderBy("point_a", F.desc("cosine"), "point_b").collect():
        got.setdefault(r.point_a, []).append(r.point_b)
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[39] == [0, 1, 2]
    assert got[100] == [0, 1, 2] and 101 not in got


def test_unusable_vectors_and_few_rows(spark):
    rows = [(1, [1, 0]), (2, [2, 0.1]), (3, None), (4, [0, 0]), (5, [1]), (6, [float("nan"), 1]), (7, [None, 1]), (None, [1, 0]), (8, [float("inf"), 1])]
    got = {(r.point_a, r.point_b) for r in similar_vectors(frame(spark, rows), "p", "v", k=5, dim=2).collect()}
    assert got == {(1, 2), (2, 1)}
    assert similar_vectors(frame(spark, []), "p", "v", dim=2).collect() == []
    assert similar_vectors(frame(spark, [(4, [0, 0])]), "p", "v", dim=2).collect() == []
    assert similar_vectors(frame(spark, [(1, [1, 0])] * 3), "p", "v", dim=2).collect() == []


def test_few_usable_rows_that_the_draw_misses(spark):
    rows = [(i, [1, i / 10]) for i in range(3)] + [(i, None) for i in range(3, 3000)]
    got = {(r.point_a, r.point_b) for r in similar_vectors(frame(spark, rows), "p", "v", k=1, dim=2, sample_rows=1).collect()}
    assert got == {(0, 1), (1, 2), (2, 1)}


def test_parts_of_parts(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 16))
    x = (centres[r.integers(60, size=3000)] + 0.15 * r.normal(size=(3000, 16))).astype(np.float32)
    ids = np.arange(3000)
    got = {}
    for row in similar_vectors(frame(spark, zip(ids.tolist(), x.tolist())), "p", "v", k=10, dim=16, probes=4, sample_rows=1000, part_rows=100, parts_most=6).collect():
        got.setdefault(row.point_a, []).append(row.point_b)
    want = brute(ids, x, 10, -1)
    assert all(len(set(v)) == len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[a]) & set(w)) / len(w) for a, w in want.items()]) >= 0.9


def test_leaves_of_a_tree():
    from reelgrid.llm.neighbours import Router, Tree

    top = Router(np.array([[5.0, -5.0], [0.0, 0.0]], np.float32), np.zeros(2, np.float32), np.array([0.5, 0.5]))
    low = Router(np.array([[0.0, 0.0, 0.0], [3.0, 0.0, -3.0]], np.float32), np.zeros(3, np.float32), np.array([0.2, 0.3, 0.5]))
    tree = Tree(top, [low, None])
    assert tree.share.tolist() == [0.1, 0.15, 0.25, 0.5]
    x = np.array([[1.0, 1.0], [-1.0, 0.0], [0.1, -1.0]], np.float32)
    assert tree.leaves(x, 2).tolist() == [[0, 1], [3, 0], [2, 3]] or tree.leaves(x, 2)[:, 0].tolist() == [0, 3, 2]
    assert (tree.leaves(x, 3) >= 0).all()


def test_a_hundred_ties_at_the_edge(spark):
    """Equal cosines between different vectors: the two mirror images of a vector are as far from the plane, whatever their number."""
    r = np.random.default_rng(6)
    turn = r.uniform(0, 2 * np.pi, size=100)
    ring = np.stack([np.cos(turn), np.sin(turn), np.full(100, 2.0)], axis=1)  # all as far from the axis
    ids = r.permutation(100)
    rows = [(1000, [0.0, 0.0, 1.0])] + [(int(i), v.tolist()) for i, v in zip(ids, ring)]
    got = [row.point_b for row in similar_vectors(frame(spark, rows), "p", "v", k=5, dim=3).where("point_a = 1000").collect()]
    # Their cosines differ in the last digits of the numbers they are made of, and none is lost to a cut before they are compared.
    u = np.float32(ring).astype(np.float64)
    cosine = u[:, 2] / np.sqrt((u * u).sum(axis=1))
    assert len(got) == 5 and cosine[[int(np.flatnonzero(ids == g)[0]) for g in got]].min() >= np.sort(cosine)[-5] - 1e-7
    same = [(i, [1.0, 0.5 if i % 2 else -0.5]) for i in range(120)] + [(500, [1.0, 0.0])]
    near = sorted(row.point_b for row in similar_vectors(frame(spark, same), "p", "v", k=7, dim=2).where("point_a = 500").collect())
    assert near == list(range(7))
