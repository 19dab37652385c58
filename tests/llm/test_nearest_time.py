from __future__ import annotations

import random

from reelgrid.llm.nearest_time import nearest_in_time

P = "v string, t bigint, n int, k int"


def brute(p, b, tol):
    out = set()
    for v, t, n, *_ in p:
        c = sorted((abs(t - s), s, i) for w, s, i, *_ in b if None not in (v, t, n, w, s, i) and w == v and abs(t - s) <= tol) if None not in (v, t, n) else []
        if c:
            out.add((v, n, c[0][2], c[0][0]))
    return out


def run(spark, p, b, tol=15, **kw):
    df = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], P)
    got = nearest_in_time(df(p), df(b), "v", "t", "t", "n", "n", tol, **kw).collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def test_brute_force(spark):
    r = random.Random(3)
    row = lambda i: (r.choice(["a", "a", "a", "b", None]), r.choice([None, *[r.randint(-50, 900)] * 20]), i)
    p, b = [row(i) for i in range(400)], [row(i) for i in range(300)]
    assert run(spark, p + p[:50], b + b[:50], bucket=40) == brute(p, b, 15)


def test_ties_go_to_the_earlier_then_the_smaller(spark):
    assert run(spark, [("a", 10, 1)], [("a", 5, 9), ("a", 15, 2), ("a", 5, 7)], bucket=10) == {("a", 1, 7, 5)}
    assert run(spark, [("a", 10, 1)], [("a", 26, 2)]) == set()
    assert run(spark, [("a", 10, 1)], [("a", 25, 2)]) == {("a", 1, 2, 15)}


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1, 1)]) == set() and run(spark, [("a", 1, 1)], []) == set() and run(spark, [], []) == set()


def test_a_crowded_bucket_is_shared_out(spark):
    probe = spark.createDataFrame([("v", i, 10 * i) for i in range(2000)], "e string, k bigint, t bigint")
    base = spark.createDataFrame([("v", i, 100 * i + 3) for i in range(200)] + [("v", 900 + i, 100 * i + 3) for i in range(200)], "e string, s bigint, t bigint")
    one = {tuple(r) for r in nearest_in_time(probe, base, "e", "t", "t", "k", "s", 60).collect()}
    many = {tuple(r) for r in nearest_in_time(probe, base, "e", "t", "t", "k", "s", 60, task_rows=150).collect()}
    assert one == many and len(one) == 1997 and all(b < 200 for _, _, b, _ in one)
