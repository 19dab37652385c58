from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import ranking, search, sequence
from reelgrid.plans import search_queries
from tests.conftest import DATA

H = "query_id bigint, score double, video_id string, shot_id int, id bigint"


def hits(spark, rows):
    return spark.createDataFrame([(1, s, v, k, i) for i, (s, v, k) in enumerate(rows)], H)


def test_overfetch():
    assert (search.overfetch_limit(10), search.overfetch_limit(0), search.overfetch_limit(100, most=200)) == (50, 5, 200)


def test_dedupe_keeps_best_and_first_of_ties(spark):
    h = hits(spark, [(0.9, "a", 1), (0.95, "a", 1), (0.95, "a", 1), (0.5, "b", 2)])
    got = ranking.dedupe_by_shot(h).orderBy("rank").collect()
    assert [(r.id, r.score, r["rank"]) for r in got] == [(1, 0.95, 1), (3, 0.5, 2)]


def test_fusion_order_and_imputation(spark):
    frames, clips = hits(spark, [(0.7, "v", 1), (0.6, "v", 2)]), hits(spark, [(0.9, "v", 2), (0.1, "v", 7)])
    got = {r.shot_id: r.score for r in ranking.fuse_frames_and_clips(frames, clips).collect()}
    assert sorted(got, key=lambda s: -got[s]) == [2, 1, 7]
    got = {r.shot_id: r.score for r in ranking.fuse_frames_and_clips(hits(spark, [(0.7, "v", 1), (0.3, "v", 2)]), hits(spark, [(0.5, "v", 2)])).collect()}
    assert got[1] == pytest.approx(0.7 + 0.5 * 0.5)


def test_fusion_without_clips_or_weight(spark):
    frames, none = hits(spark, [(0.7, "v", 1)]), hits(spark, [])
    assert [r.score for r in ranking.fuse_frames_and_clips(frames, none).collect()] == [0.7]
    assert [r.score for r in ranking.fuse_frames_and_clips(frames, frames, 0).collect()] == [0.7]


def test_a_query_without_a_second_list_keeps_its_rows(spark):
    """Its rows stay uncollapsed with their own scores; other queries are fused."""
    first = hits(spark, [(0.9, "v", 1), (0.8, "v", 1)]).unionByName(spark.createDataFrame([(2, 0.7, "v", 1, 9), (2, 0.6, "v", 1, 10)], H))
    second = hits(spark, [(0.5, "v", 1)])
    for fused in (ranking.fuse_frames_and_clips(first, second), ranking.rrf_two(first, second)):
        assert sorted((r.score, r.id) for r in fused.where("query_id = 2").collect()) == [(0.6, 10), (0.7, 9)]
        assert fused.where("query_id = 1").count() == 1
    assert sorted(r.score for r in ranking.rrf_two(first, second, 0).collect()) == [0.6, 0.7, 0.8, 0.9]


def test_the_primary_row_is_carried_and_gains_the_text(spark):
    t = H + ", ocr_text string"
    a = spark.createDataFrame([(1, 0.8, "v", 1, 5, None), (1, 0.7, "v", 2, 6, None)], t)
    b = spark.createDataFrame([(1, 3.0, "v", 2, 7, "bờ sông"), (1, 2.0, "v", 3, 8, "chợ")], t)
    got = {r.shot_id: (r.id, r.ocr_text) for r in ranking.rrf_two(a, b).collect()}
    assert got == {1: (5, None), 2: (6, "bờ sông"), 3: (8, "chợ")}


def test_knn_leaves_unusable_vectors_out(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0]), (None, [1.0, 0.0])]
    base = spark.createDataFrame(rows, "id bigint, v array<float>")
    for size in (0, 1_000_000):
        got = search.knn(base.selectExpr("id as query_id", "v"), base, 3, 2, query_bytes=size).collect()
        assert sorted((r.query_id, r.id) for r in got) == [(1, 6), (6, 1)]
        assert search.knn(base.limit(0).selectExpr("id as query_id", "v"), base, 3, 2, query_bytes=size).collect() == []


def test_rrf(spark):
    one = hits(spark, [(0.9, "v", 1)])
    assert ranking.rrf_two(one, one, 0.5).first().score == pytest.approx(1 / 61 + 0.5 / 61)
    both = ranking.rrf_two(hits(spark, [(0.9, "v", 1), (0.8, "v", 2)]), hits(spark, [(3.0, "v", 2)]), 1.0).orderBy(F.desc("score")).collect()
    assert [r.shot_id for r in both] == [2, 1]


def test_normalize(spark):
    got = [r.score for r in ranking.normalize(hits(spark, [(0.2, "a", 1), (0.7, "b", 1), (0.45, "c", 1)])).orderBy("id").collect()]
    assert got == pytest.approx([0, 1, 0.5])
    assert [r.score for r in ranking.normalize(hits(spark, [(0.4, "a", 1), (0.4, "b", 1)])).collect()] == [1.0, 1.0]


def test_weighted_fusion(spark):
    a, b = hits(spark, [(1.0, "a", 1), (0.0, "b", 1)]), hits(spark, [(0.0, "a", 1), (1.0, "b", 1)])
    got = {r.video_id: r.score for r in ranking.weighted_fusion([(a, 0.7), (b, 0.3)], ["query_id", "video_id"]).collect()}
    assert got == pytest.approx({"a": 0.7, "b": 0.3})


def test_speech_bonus_takes_the_best_and_includes_ends(spark):
    f = spark.createDataFrame([(1, 0.5, "v", 1, 7, 10.0, 20.0), (1, 0.5, "v", 2, 8, None, None)], H + ", low double, high double")
    s = spark.createDataFrame([(1, "v", 21.0, 22.0, 0.9), (1, "v", 0.0, 9.0, 0.5), (1, "v", 500.0, 501.0, 0.1)], "query_id bigint, video_id string, start_sec double, end_sec double, score double")
    got = {r.id: r.score for r in ranking.speech_bonus(f, s, 0.3, 1.0).collect()}
    assert got == pytest.approx({7: 0.8, 8: 0.5})


def test_rerank_head(spark):
    h = ranking.ranked(hits(spark, [(0.9, "a", 1), (0.8, "b", 1), (0.7, "c", 1)]))
    got = ranking.rerank_head(h, F.col("id").cast("double"), 2).orderBy("new_rank").collect()
    assert [(r.video_id, r.block) for r in got] == [("b", 0), ("a", 0), ("c", 1)]
    one = ranking.rerank_head(ranking.ranked(hits(spark, [(0.9, "a", 1)])), F.lit(0.0), 2).collect()
    assert one[0].score == 0.9


S = "query_id bigint, video_id string, event int, frame_id bigint, pts_sec double, shot_id int, score double"


def best(spark, rows, n, **kw):
    got = sequence.best_sequences(spark.createDataFrame([(1, v, e, f, t, 0, s) for v, e, f, t, s in rows], S), n, **kw).collect()
    return {r.video_id: ([p.frame_id for p in r.picks], r.score) for r in got}


def test_sequence_charges_the_gap_before_it_chooses(spark):
    rows = [("v", 0, 10, 0.0, 0.50), ("v", 0, 20, 100.0, 0.48), ("v", 1, 30, 105.0, 0.70)]
    assert best(spark, rows, 2)["v"][0] == [20, 30]


def test_sequence_gap_rules(spark):
    rows = [("v", 0, 10, 10.0, 0.5), ("v", 1, 50, 400.0, 0.6)]
    assert best(spark, rows, 2, max_gap=60.0) == {}
    assert best(spark, rows, 2, max_gap=0.0)["v"][0] == [10, 50]
    assert best(spark, [("v", 0, 1, None, 0.8), ("v", 1, 2, None, 0.6)], 2)["v"][1] == pytest.approx(0.7)
    assert best(spark, [("v", 0, 5, 0.0, 0.8), ("v", 1, 5, 0.0, 0.6)], 2) == {}


def test_sequence_against_brute_force(spark):
    import itertools
    import math
    import random

    r = random.Random(5)
    rows = [("v", e, r.randint(0, 60), float(r.randint(0, 400)), r.random()) for e in range(3) for _ in range(8)]
    pen = lambda g: math.log1p(g) / math.log1p(300) if g > 0 else 0.0
    want = None
    for a, b, c in itertools.product(*[[x for x in rows if x[1] == e] for e in range(3)]):
        if a[2] < b[2] < c[2] and b[3] - a[3] <= 300 and c[3] - b[3] <= 300:
            s = (a[4] + b[4] + c[4] - 0.075 * (pen(b[3] - a[3]) + pen(c[3] - b[3]))) / 3
            want = s if want is None else max(want, s)
    assert best(spark, rows, 3)["v"][1] == pytest.approx(want)


def test_alternates(spark):
    slots = spark.createDataFrame([(1, "v", 0, 50, 0.0, 0, 0.9), (1, "v", 1, 900, 90.0, 0, 0.9), (1, "v", 1, 60, 6.0, 0, 0.5), (1, "v", 1, 800, 80.0, 0, 0.5), (1, "v", 1, 40, 4.0, 0, 0.8)], S)
    alt = sequence.alternates(slots, sequence.best_sequences(slots, 2, gap_weight=0.0)).where("event = 1").orderBy("place").collect()
    assert [r.frame_id for r in alt] == [60, 800]


@pytest.mark.parametrize("query_bytes", [0, 1_000_000])
def test_knn_is_exact_over_blocks(spark, query_bytes):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 8)).astype("float32")
    x[7] = x[3]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    got = search.knn(base.where("id < 5").selectExpr("id as query_id", "v"), base, 4, 8, base_block=40, query_block=2, query_bytes=query_bytes).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(5):
        s = np.round(u @ u[q], 6)
        s[q] = -9
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == list(np.lexsort((np.arange(300), -s))[:4])


@pytest.mark.parametrize("query_bytes", [0, 1_000_000])
@pytest.mark.parametrize("scaled", [False, True])
def test_knn_ties_beyond_the_block_winners(spark, scaled, query_bytes):
    import numpy as np

    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(1, 8)), 300, axis=0) * (r.uniform(0.1, 30, size=(300, 1)) if scaled else 1)
    ids = r.permutation(300).tolist()
    base = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x.astype("float32"))] + [(1000 + i, v.tolist()) for i, v in enumerate(r.normal(size=(100, 8)))], "id bigint, v array<float>")
    got = search.knn(base.where("id in (0, 150, 299)").selectExpr("id as query_id", "v"), base, 4, 8, query_bytes=query_bytes).collect()
    for q, want in ((0, [1, 2, 3, 4]), (150, [0, 1, 2, 3]), (299, [0, 1, 2, 3])):
        assert [h.id for h in sorted((h for h in got if h.query_id == q), key=lambda h: h["rank"])] == want


def test_the_bonus_meets_each_span_once(spark):
    """kis_visual_asr (F4): a query's frames of one window met all its segments of one span, each with each."""
    f = spark.createDataFrame([(1, 0.5, "v", 1, i, 10.0, 20.0) for i in range(60)], H + ", low double, high double")
    s = spark.createDataFrame([(1, "v", 15.0, 16.0, i / 50) for i in range(51)], "query_id bigint, video_id string, start_sec double, end_sec double, score double")
    out = ranking.speech_bonus(f, s, 0.3, 1.0)
    assert {r.id: round(r.score, 9) for r in out.collect()} == {i: 0.8 for i in range(60)}
    assert max(_joined(out._jdf.queryExecution().executedPlan())) <= 60


def _joined(plan):
    """The rows that came out of each join of a plan that has run."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().length())]
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in name and plan.metrics().contains("numOutputRows") else []
    return own + [n for p in inner for n in _joined(p)]


class _Met(Exception):
    pass


#: Searches of vectors in which each partition of the base sent its k best of every query: F5, F8, F9.
@pytest.mark.parametrize("name", ["rrf_multi_list", "hybrid_search", "rrf_two_list"])
def test_few_partitions_send_their_best(spark, name, monkeypatch):
    if not DATA.exists():
        pytest.skip("no test data")
    base = spark.range(1, 901).select("id", F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(search_queries.DIM)]).alias("v")).repartition(60)
    sent, knn, dim = [], search.knn, search_queries.DIM
    top = search.top_per_query

    def met(q, b, k, d):
        assert d == dim
        monkeypatch.setattr(search, "top_per_query", lambda hits, *x: sent.append(hits) or top(hits, *x))
        want = knn(base.where("id <= 8").withColumnRenamed("id", "query_id"), base, k, d)
        text = sent[0]._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition %d, false" % spark.sparkContext.defaultParallelism in text
        assert want.count() == 8 * k
        raise _Met

    monkeypatch.setattr(search, "knn", met)
    with pytest.raises(_Met):
        search_queries.QUERIES[name](spark, str(DATA))


def test_what_was_found_saves_comparisons(monkeypatch):
    """rrf_multi_list (F5), hybrid_search (F8): every chunk compared its own k best, whatever the ones before had found; ids come once, ties by id."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[400:500] = x[:100]
    ids = np.concatenate([rng.permutation(500), rng.permutation(500)[:100]])
    x[500:] = x[[int(np.flatnonzero(ids[:500] == i)[0]) for i in ids[500:]]]
    monkeypatch.setattr(search, "CHUNK", 20)
    q, k = search._unit(x[:30].astype(float)), 5
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 20]), pa.array(list(x[a : a + 20]), pa.list_(pa.float32()))], names=["id", "v"]) for a in range(0, 600, 20)]
    compared, candidates = [], getattr(search, "_candidates", None)
    if candidates:
        monkeypatch.setattr(search, "_candidates", lambda *a: (compared.append(len(c[0])) or c for c in candidates(*a)))
    got = {}
    for b in search._partition(SimpleNamespace(value=(ids[:30], q)), k, 8, True)(iter(batches)):
        for a, i, s in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(a, []).append((i, round(s, 6)))
    scores = np.round(q @ search._unit(x.astype(float)).T, 6)
    want = {int(ids[r]): [(i, -s) for s, i in sorted({(-float(s), int(i)) for s, i in zip(scores[r], ids) if i != ids[r]})[:k]] for r in range(30)}
    assert got == {a: [(i, round(s, 6)) for i, s in hits] for a, hits in want.items()}
    assert candidates and sum(compared) < 30 * 30 * k / 2
