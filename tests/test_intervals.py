from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators.intervals import periods_and_gaps

SCHEMA = "k string, a bigint, b bigint, k2 int, `__s` string"


def brute(rows):
    out = set()
    for k in {r[0] for r in rows}:
        spans = sorted((a, b) for x, a, b, *_ in rows if x == k and a is not None and b is not None and b >= a)
        if not spans:
            continue
        lo, hi = spans[0]
        for a, b in spans[1:]:
            if a <= hi:
                hi = max(hi, b)
            else:
                out |= {(k, "period", lo, hi), (k, "gap", hi, a)}
                lo, hi = a, b
        out.add((k, "period", lo, hi))
    return out


def run(spark, rows, n=None):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = periods_and_gaps(df, ["k"], F.col("a"), F.col("b"), n).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(300):
        a = r.choice([None, r.randint(0, 400)]) if r.random() < 0.1 else r.randint(0, 400)
        b = None if a is None or r.random() < 0.05 else a + r.randint(-3, 12)
        rows.append((r.choice(["hot", "hot", "b", "c", None]), a, b))
    assert run(spark, rows + rows[:40], 5) == brute(rows)


def test_one_long_period_over_many_partitions(spark):
    rows = [("v", i, i + 1) for i in range(500)] + [("v", 0, 10_000), ("w", 3, 3), ("w", 3, 3)]
    assert run(spark, rows, 7) == {("v", "period", 0, 10_000), ("w", "period", 3, 3)}


def test_very_many_equal_rows(spark):
    assert run(spark, [("v", 5, 9)] * 600 + [("v", 11, 12)], 6) == {("v", "period", 5, 9), ("v", "gap", 9, 11), ("v", "period", 11, 12)}


def test_empty_and_all_invalid(spark):
    assert run(spark, []) == set()
    assert run(spark, [("v", 5, 1), ("v", None, 2), (None, 1, None)]) == set()
