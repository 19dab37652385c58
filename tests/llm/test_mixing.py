from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelgrid.llm.mixing import mix_sources, quality_weight

D = "doc_id bigint, source string, n_tokens int, weight double, copies int"
G = "source string, target_share double, max_repeats int"


def run(spark, docs, goals, **kw):
    m, r = mix_sources(spark.createDataFrame([(*d, 1) for d in docs], D), spark.createDataFrame(goals, G), **kw)
    return {x.doc_id: x.copies for x in m.collect()}, {x.source: x for x in r.collect()}


def test_shares_and_caps(spark):
    docs = [(i, "big", 10, 1.0) for i in range(6000)] + [(10_000 + i, "small", 10, 0.5) for i in range(100)]
    m, r = run(spark, docs, [("big", 0.6, 1), ("small", 0.4, 3)])
    assert r["small"].actual_share == pytest.approx(0.4, abs=0.002) and r["big"].actual_share == pytest.approx(0.6, abs=0.002)
    assert max(m.values()) == 3 and all(m[10_000 + i] == 3 for i in range(100))
    assert sum(c * 10 for d, c in m.items()) == sum(x.taken_tokens for x in r.values())


def test_part_of_an_epoch_and_a_given_total(spark):
    docs = [(i, "a", 7, 1.0) for i in range(1000)] + [(2000 + i, "b", 3, 1.0) for i in range(1000)]
    m, r = run(spark, docs, [("a", 0.5, 5), ("b", 0.5, 5)], total=10_000)
    assert abs(r["a"].taken_tokens - 5000) <= 7 and abs(r["b"].taken_tokens - 5000) <= 3
    copies = [m.get(2000 + i, 0) for i in range(1000)]
    assert set(copies) == {1, 2}  # a whole epoch, then a part of the next


def test_heavier_documents_are_taken_more_often(spark):
    docs = [(i, "a", 1, 1.0 if i % 2 else 0.1) for i in range(4000)]
    m, _ = run(spark, docs, [("a", 1.0, 1)], total=1000)
    assert sum(1 for d in m if d % 2) > 800


def test_unusable_rows_and_empty_tables(spark):
    docs = [(1, None, 5, 1.0), (2, "none", 5, 1.0), (3, "a", 0, 1.0), (4, "a", None, 1.0), (5, "a", 5, None), (6, "a", 5, -1.0)]
    m, r = run(spark, docs, [("a", 0.5, None), ("a", 0.5, None), ("gone", 0.5, 2), ("zero", None, 1), (None, 0.1, 1)])
    assert m == {5: 1, 6: 1} and r["gone"].taken_tokens == 0 and r["a"].actual_share == r["a"].reachable_share == 1.0 and set(r) == {"a", "gone", "zero"}
    m, r = run(spark, [], [("a", 1.0, 1)])
    assert m == {} and r["a"].actual_share == 0
    assert run(spark, docs, []) == ({}, {})


def test_quality(spark):
    df = spark.createDataFrame([("abc def",), ("12345",), ("",), (None,)], "t string")
    assert [r.w for r in df.select(quality_weight(F.col("t")).alias("w")).collect()] == [1.0, 0.25, 0.25, 0.25]
