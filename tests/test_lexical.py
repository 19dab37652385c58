from __future__ import annotations

from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import lexical, search
from reelgrid.operators.lexical import LexicalIndex, query_terms
from reelgrid.plans import entry_queries, search_queries
from tests.conftest import DATA, needs_data

WORDS = [f"w{i}" for i in range(30)]


def _drawn(rng, n: int):
    """Texts in which the first words are frequent; short, so that many are equal."""
    return [[WORDS[min(29, int(x))] for x in rng.exponential(4, rng.integers(1, 6))] for _ in range(n)]


def _all_pairs(asked, docs, k):
    out = {}
    for q, words in asked.items():
        scores = [(-round(float(sum(w * weights.get(t, 0.0) for t, w in words.items())), 6), i) for i, weights in docs if set(words) & set(weights)]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def _lists(docs):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([list(w) for _, w in docs], pa.list_(pa.string())), pa.array([list(w.values()) for _, w in docs], pa.list_(pa.float64()))], names=["id", "tokens", "weights"])


def _searched(asked, batches, k):
    vocabulary = sorted({t for w in asked.values() for t in w})
    at = {t: i for i, t in enumerate(vocabulary)}
    value = (pa.array(vocabulary, pa.string()), [np.array([at[t] for t in w], np.int64) for w in asked.values()], [np.array(list(w.values())) for w in asked.values()], [np.array([q], np.int64) for q in asked])
    found = defaultdict(list)
    for b in search._words_partition(SimpleNamespace(value=value), k)(iter(batches)):
        for q, i, s in zip(*(c.to_pylist() for c in b.columns)):
            found[q].append((i, s))
    return {q: found[q] for q in asked}


def test_documents_left_out_are_no_hits():
    """Blocks of 40 documents and more; ties and equal documents at the edge, one weight below 0."""
    rng = np.random.default_rng(5)
    docs = [(int(i), {t: float(text.count(t)) for t in text}) for i, text in zip(rng.permutation(1500), _drawn(rng, 1500))]
    asked = {q: {t: round(1.0 + WORDS.index(t) / 7, 3) for t in text} for q, text in enumerate(_drawn(rng, 60))}
    asked[99] = {"w0": -0.001, "w3": 2.0}
    for k in (1, 7, 50):
        got = _searched(asked, [_lists(docs[a : a + 40]) for a in range(0, 1500, 40)], k)
        assert {q: [(i, round(s, 6)) for i, s in hits] for q, hits in got.items()} == _all_pairs(asked, docs, k)


def test_no_pairs_are_made(spark):
    """idf_sparse_topk (F2): queries and documents that share a word were all joined."""
    index = LexicalIndex(spark.range(300).select("id", F.concat(F.lit("chung t"), F.col("id") % 7).alias("t")))
    words = query_terms(spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("chung t"), F.col("id") % 7).alias("t")))
    hits = index.search(words, 3)
    assert "Join" not in hits._jdf.queryExecution().optimizedPlan().toString()
    rows = hits.orderBy("query_id", "rank").collect()
    assert [(r.id, r.rank) for r in rows[:6]] == [(0, 1), (7, 2), (14, 3), (1, 1), (8, 2), (15, 3)] and len(rows) == 120


def test_several_passes(spark):
    index = LexicalIndex(spark.range(50).select("id", F.concat(F.lit("chung t"), F.col("id") % 7).alias("t")))
    words = query_terms(spark.range(20).select(F.col("id").alias("query_id"), F.concat(F.lit("t"), F.col("id") % 9).alias("t")))
    once = index.search(words, 3).collect()
    assert sorted(search.sparse_search(words, index.documents, index.idf, 3, query_bytes=1500).collect()) == sorted(once)


def test_texts_of_one_id_and_of_none(spark):
    """Texts without an id are one document that isn't counted, as in SQL."""
    rows = [(1, "sông lớn"), (1, "sông"), (2, "chợ"), (None, "sông"), (None, "lớn"), (3, None), (4, "!")]
    index = LexicalIndex(spark.createDataFrame(rows, "id bigint, t string"))
    got = {(r.id, r.token): r.weight for r in index.postings.collect()}
    assert got == {(1, "sông"): 2.0, (1, "song"): 1.0, (1, "lớn"): 1.0, (1, "lon"): 0.5, (2, "chợ"): 1.0, (2, "cho"): 0.5, (None, "sông"): 1.0, (None, "song"): 0.5, (None, "lớn"): 1.0, (None, "lon"): 0.5}
    assert {r.token: round(r.idf, 6) for r in index.idf.collect()}["chợ"] == round(float(np.log1p((2 - 1 + 0.5) / 1.5)), 6)
    hits = index.search(query_terms(spark.createDataFrame([(9, "chợ")], "query_id bigint, t string")), 5).collect()
    assert [(r.query_id, r.id) for r in hits] == [(9, 2)]


@needs_data
def test_the_screen_search_keeps_no_vectors(spark):
    """search_ocr_rows (F6): vectors, shots and speech were written that it never reads."""
    corpus = entry_queries._screen_corpus(spark, str(DATA))
    assert corpus.shots is None and corpus.segments is None and corpus.speech_index is None and "v" not in corpus.frames.columns


#: Searches that joined every query with every document that shares a word: F8, F1, F5, F7, F9, F4, F3.
NO_PAIRS = ["hybrid_search", "asr_weighted_fusion", "rrf_multi_list", "asr_only", "rrf_two_list", "kis_visual_asr", "asr_nearest_frame"]


@needs_data
@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_postings_are_read(spark, name, monkeypatch):
    def postings(self):
        raise AssertionError("postings")

    monkeypatch.setattr(LexicalIndex, "postings", property(postings))
    monkeypatch.setattr(search_queries, "_INDEXES", {})
    assert search_queries.QUERIES[name](spark, str(DATA)).columns


def test_batches_and_both_kinds_of_tokens(monkeypatch):
    """Few columns and few queries at once: most tokens are added up pair by pair, the result is the same."""
    rng = np.random.default_rng(6)
    docs = [(int(i), {t: float(text.count(t)) for t in text}) for i, text in zip(rng.permutation(900), _drawn(rng, 900))]
    asked = {q: {t: round(0.5 + WORDS.index(t) / 9, 3) for t in text} for q, text in enumerate(_drawn(rng, 50))}
    asked |= {98: {"w0": 0.0, "w29": 0.0}, 99: {"w1": -0.5, "w2": 0.001}}
    monkeypatch.setattr(search, "COLUMNS", 3, raising=False)
    monkeypatch.setattr(search, "CELLS", 400, raising=False)
    for k in (1, 40):
        got = _searched(asked, [_lists(docs[a : a + 100]) for a in range(0, 900, 100)], k)
        assert {q: [(i, round(s, 6)) for i, s in hits] for q, hits in got.items()} == _all_pairs(asked, docs, k)


class _Searched(Exception):
    pass


#: Searches that went through the documents query by query: F1, F7, F8, F5, F3, F9, F4.
TOGETHER = ["asr_weighted_fusion", "asr_only", "hybrid_search", "rrf_multi_list", "asr_nearest_frame", "rrf_two_list", "kis_visual_asr"]


@needs_data
@pytest.mark.parametrize("name", TOGETHER)
def test_queries_are_searched_together(spark, name, monkeypatch):
    """The query's own documents and words, the words 200 times with other weights: the steps don't grow with the queries."""

    def searched(queries, documents, idf, k):
        words, tokens, weights, _ = search._asked(queries.join(idf, "token").select("query_id", "token", (F.col("weight") * F.col("idf")).alias("qw")))
        more = [(t, w * (1 + i / 1000)) for i in range(200) for t, w in zip(tokens, weights)]
        asked = words, [t for t, _ in more], [w for _, w in more], [np.array([q], np.int64) for q in range(len(more))]
        steps, spans = [], search._spans
        monkeypatch.setattr(search, "_spans", lambda *x: steps.append(1) or spans(*x))
        batches = documents.select("id", "tokens", "weights").toArrow().combine_chunks().to_batches()
        hits = sum(b.num_rows for b in search._words_partition(SimpleNamespace(value=asked), k)(iter(batches)))
        assert hits and len(steps) < 40
        raise _Searched

    monkeypatch.setattr(lexical, "sparse_search", searched)
    monkeypatch.setattr(search_queries, "_INDEXES", {})
    with pytest.raises(_Searched):
        search_queries.QUERIES[name](spark, str(DATA))


@needs_data
def test_a_query_brings_each_span_once(spark, monkeypatch):
    """asr_only (F7): the segments of all queries met the frames, a segment as often as it was found."""

    def met(left, right, *_):
        assert left.count() == left.select("video_id", "start_sec", "end_sec").distinct().count()
        raise _Searched

    fused = search_queries._fused_speech(spark, str(DATA))
    twice = fused.unionByName(fused.withColumn("query_id", F.col("query_id") + 1))
    monkeypatch.setattr(search_queries, "_fused_speech", lambda *_: twice)
    monkeypatch.setattr(search_queries.temporal, "overlapping", met)
    with pytest.raises(_Searched):
        search_queries.QUERIES["asr_only"](spark, str(DATA))


def test_shared_ids_are_added_up_without_postings(spark, monkeypatch):
    """rrf_multi_list (F5), hybrid_search (F8): texts that share an id were shuffled token by token, twice."""
    exploded, shown = lexical._exploded, []
    monkeypatch.setattr(lexical, "_exploded", lambda df: shown.append(df.where("id is not null").count()) or exploded(df))
    texts = spark.createDataFrame([(1, "sông sông"), (1, "sông núi"), (2, "núi"), (None, "cầu"), (None, "cầu mới")], "id bigint, t string")
    index = LexicalIndex(texts)
    assert not sum(shown)
    got = sorted((str(r.id), r.token, r.weight) for r in index.postings.collect())
    assert got == sorted([("1", "sông", 3.0), ("1", "song", 1.5), ("1", "núi", 1.0), ("1", "nui", 0.5), ("2", "núi", 1.0), ("2", "nui", 0.5), ("None", "cầu", 2.0), ("None", "cau", 1.0), ("None", "mới", 1.0), ("None", "moi", 0.5)])


def test_one_great_document_leaves_the_others_out(monkeypatch):
    """rrf_two_list (F9): texts without an id are one document of great weights, beside which all others of its block were scored exactly."""
    rng = np.random.default_rng(8)
    docs = [(int(i), {t: float(text.count(t)) for t in text}) for i, text in zip(rng.permutation(900), [[WORDS[int(x)] for x in rng.integers(0, 30, 6)] for _ in range(900)])]
    asked = {q: {f"w{j}": 1.0 + (q * j) % 7 / 10 for j in range(q % 5, 30, 5)} for q in range(20)}
    read = []
    for more in ([], [(5000, {w: 1e9 for w in WORDS})]):
        steps, spans = [], search._spans
        with monkeypatch.context() as m:
            m.setattr(search, "_spans", lambda a, b: steps.append(len(a)) or spans(a, b))
            got = _searched(asked, [_lists(docs + more)], 5)
        assert {q: [(i, round(s, 6)) for i, s in hits] for q, hits in got.items()} == _all_pairs(asked, docs + more, 5)
        read.append(sum(steps))
    assert read[1] < read[0] + 500
