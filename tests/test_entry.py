from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelgrid.operators.lexical import LexicalIndex
from reelgrid.plans import entry

FRAMES = "point_id bigint, video_id string, keyframe_n int, id bigint, shot_id int, frame_id bigint, pts_sec double, low double, high double, ocr_text string, v array<float>"
CONFIG = entry.RetrievalConfig(dim=3)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "a" if i < 3 else "b", i, 100 + i, i, 10 * i, float(i), float(i), float(i), t, v) for i, (t, v) in enumerate([("sông lớn", [1.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0]), ("chợ", [0.0, 0.0, 1.0]), ("sông", [1.0, 0.2, 0.0]), (None, [1.0, 1.0, 0.1])])]
    frames = spark.createDataFrame(rows, FRAMES)
    said = spark.createDataFrame([(1, "b", 7, 3.2, 4.4, "trời mưa to", [0.0, 1.0, 0.0])], "id bigint, video_id string, segment int, start_sec double, end_sec double, text string, v array<float>")
    screen = LexicalIndex(frames.where("ocr_text is not null").select("id", F.col("ocr_text").alias("t")))
    return entry.Corpus(frames, frames.select("id", "video_id", "shot_id", "v"), said, screen, LexicalIndex(said.select("id", F.col("text").alias("t"))))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, [1.0, 0.0, 0.0], "sông", "mưa", [0.0, 1.0, 0.0])], "query_id bigint, v array<float>, text string, speech string, speech_v array<float>")


def test_rows_of_all_tracks_have_one_shape(spark, corpus, asked):
    q = asked.select("query_id", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("event"), F.lit(None).cast("bigint").alias("point_id"), "v")
    made = [entry.search_kis(asked, corpus, CONFIG), entry.search_qa(asked, corpus, CONFIG, mode="visual"), entry.search_frames(asked, corpus, CONFIG, mode="asr_only"), entry.search_ocr(asked, corpus, CONFIG), entry.search_trake(q, corpus, CONFIG, 2)]
    want = ["query_id", "rank", "video_id", "frame_ids", "score", *entry.SCHEMA]
    for m in made:
        assert m.columns == want and {c: m.schema[c].dataType.simpleString() for c in ("stage_a", "events")} == {c: m.schema[c].dataType.simpleString() for c in ("stage_a", "events")}
        assert m.count() > 0


def test_pictures_and_speech(corpus, asked):
    t = entry.Timings()
    plain = entry.search_kis(asked, corpus, CONFIG.resolved(clip_weight=0.0), 3, "visual", timings=t).orderBy("rank").collect()
    assert [r.frame_ids for r in plain] == [[0], [30], [40]] and plain[0].ocr_text is None and list(t.rounded()) == ["search"]
    heard = entry.search_kis(asked, corpus, CONFIG.resolved(clip_weight=0.0, asr_weight=0.9), 3).orderBy("rank").collect()
    assert [r.frame_ids for r in heard] == [[30], [40], [0]]  # frames around the segment gain, the seconds before it too
    boosted = entry.search_kis(asked, corpus, CONFIG.resolved(clip_weight=0.0, ocr_boost_enabled=True, ocr_boost_weight=5.0), 2, "visual").orderBy("rank").collect()
    assert [r.ocr_text for r in boosted] == ["sông", "sông lớn"] or [r.ocr_text for r in boosted] == ["sông lớn", "sông"]


def test_speech_alone_tells_its_evidence(corpus, asked):
    r = entry.search_frames(asked, corpus, CONFIG, mode="asr_only").collect()
    assert [(x.video_id, x.frame_ids, x.asr_evidence.segment, x.asr_evidence.text) for x in r] == [("b", [40], 7, "trời mưa to")]


def test_words_on_screen(spark, corpus, asked):
    r = entry.search_ocr(asked, corpus, CONFIG).orderBy("rank").collect()
    assert {(x.frame_ids[0], x.ocr_text) for x in r} == {(0, "sông lớn"), (30, "sông")}
    assert entry.search_ocr(asked.withColumn("text", F.lit("  ")), corpus, CONFIG).collect() == []


def test_a_sequence_tells_events_and_stage_a(spark, corpus):
    q = spark.createDataFrame([(1, 0, None, [1.0, 0.0, 0.0]), (1, 1, None, [1.0, 1.0, 0.0]), (1, -1, None, [1.0, 0.0, 0.0])], "query_id bigint, event int, point_id bigint, v array<float>")
    r = entry.search_trake(q, corpus, CONFIG, 2).orderBy("rank").collect()
    top = r[0]
    assert (top.video_id, top.frame_ids, top.stage_a["rank"]) == ("b", [30, 40], 1) and len(top.stage_a.event_scores) == 2
    assert [(e.event_index, e.frame_id) for e in top.events] == [(0, 30), (1, 40)]
    one = entry.search_trake(q, corpus, CONFIG, 2, single_frame=True, videos=spark.createDataFrame([(1, "b")], "query_id bigint, video_id string")).collect()
    assert len(one) == 1 and one[0].stage_a is None and one[0].frame_ids == [40]


def test_overrides_and_errors(corpus, asked):
    assert CONFIG.resolved(clip_weight=None, asr_weight=0.1) == entry.RetrievalConfig(dim=3, asr_weight=0.1)
    with pytest.raises(ValueError, match="no mode"):
        entry.search_frames(asked, corpus, CONFIG, mode="sound")
    with pytest.raises(ValueError, match="speech"):
        entry.search_frames(asked, corpus, CONFIG.resolved(asr_enabled=False), mode="asr_only")
