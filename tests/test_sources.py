from __future__ import annotations

import json

import numpy as np
import pytest

from reelgrid.sources import readers, writers
from reelgrid.sources.schemas import CLIP, require_columns
from reelgrid.streaming import ingest


def test_keyframe_map(spark, tmp_path):
    (tmp_path / "L01_V001.csv").write_text("﻿n,pts_time,fps,frame_idx\n2,1.0,25,25\n1,0.0,25,0\n3,2.0,30,50\n", encoding="utf-8")
    r = readers.keyframe_map(spark, str(tmp_path)).orderBy("keyframe_n").collect()
    assert [(x.video_id, x.keyframe_n, x.original_frame_id, x.fps) for x in r] == [("L01_V001", 1, 0, 25.0), ("L01_V001", 2, 25, 25.0), ("L01_V001", 3, 50, 25.0)]


HEAD = "segment,start,end,duration,text,speech_score,video_id,title,author,channel_id,watch_url,text_corrected,entities"


def test_speech_csv(spark, tmp_path):
    rows = ["""1,5,2,3,raw,0.5,v,nan,A,c,u,two words,"{'persons': ['X O''Y', 'X O''Y', 'nan'], 'orgs': [], 'locations': ""oops""}" """.replace("''", "\\'").strip(), "2,1,2,1,short,0.5,v,t,A,c,u,one,{}", "bad,,2,x,t,,,t,A,c,u,hai chữ,oops", "4,1,2,1,raw text stays out,0.5,v,t,A,c,u,nan,{}"]
    (tmp_path / "w_segments_enriched.csv").write_text("\n".join([HEAD, *rows]))
    r = readers.speech_csv(spark, str(tmp_path)).orderBy("video_id").collect()
    assert [(x.video_id, x.segment, x.start_sec, x.end_sec, x.duration, x.text_corrected, x.title, x.asr_persons, x.asr_locations) for x in r] == [("v", 1, 2.0, 5.0, 3.0, "two words", "", ["X O'Y"], []), ("w", 0, 0.0, 2.0, 0.0, "hai chữ", "t", [], [])]


def test_speech_spans_keep_any_text(spark, tmp_path):
    rows = ["""1,5,2,3,raw,0.5,v,t,A,c,u,nan,"{'persons': ['A', ' '], 'orgs': ['B']}" """.strip(), "2,x,2,1,no start,0.5,v,t,A,c,u,one,{}", "3,1,2,1,,0.5,v,t,A,c,u,,{}", "4,1,2,1,,0.5,v,t,A,c,u,one,oops"]
    (tmp_path / "v.csv").write_text("\n".join([HEAD, *rows]))
    r = readers.speech_spans(spark, str(tmp_path)).orderBy("start_sec").collect()
    assert [(x.video_id, x.start_sec, x.end_sec, x.text, x.text_corrected, x.entities) for x in r] == [("v", 1.0, 2.0, "", "one", []), ("v", 5.0, 5.0, "raw", "", ["A", "B"])]


def test_an_empty_keyframe_map_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,25,0\n")
    (tmp_path / "b.csv").write_text("n,pts_time,fps,frame_idx\n")
    with pytest.raises(ValueError, match="empty keyframe map: b"):
        readers.keyframe_map(spark, str(tmp_path))


def test_the_last_enrichment_of_the_last_file_counts(spark, tmp_path):
    line = '{{"video_id": "v", "keyframe_n": 1, "caption": "{}"}}\n'
    (tmp_path / "a.jsonl").write_text(line.format("a1") * 3)
    (tmp_path / "b.jsonl").write_text(line.format("b1") + line.format("b2"))
    assert [x.caption for x in readers.enrichment_lines(spark, str(tmp_path)).collect()] == ["b2"]


def test_media_info_ids(spark):
    texts = ['{"watch_url": "https://a.example/watch?v=abcdefghijk&x=1"}', '{"watch_url": "none", "thumbnail_url": "https://i.example/vi/ABCDEFGHIJK/0.jpg"}', '{"title": "x"}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in df.select("i", readers.media_info_id(df.t).alias("x")).orderBy("i").collect()] == ["abcdefghijk", "ABCDEFGHIJK", None, None]


def test_snapshot_and_restore(spark, tmp_path):
    c = writers.Collection(spark, str(tmp_path / "col"))
    c.create(spark.createDataFrame([(1, "a")], "id int, x string"))
    c.snapshot(str(tmp_path / "snap"), "1.9.2")
    c.upsert(spark.createDataFrame([(1, "b")], "id int, x string"), ["id"])
    with pytest.raises(ValueError, match="can't be restored"):
        c.restore(str(tmp_path / "snap"), "1.8.0")
    c.restore(str(tmp_path / "snap"), "1.9.2")
    assert [r.x for r in c.current().collect()] == ["a"]
    spark.createDataFrame([(9, "z")], "id int, x string").write.mode("append").parquet(str(tmp_path / "snap" / "rows"))
    with pytest.raises(ValueError, match="changed"):
        c.restore(str(tmp_path / "snap"), "1.9.2")


def test_json_and_text_sources(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "v.json").write_text(json.dumps([{"start": 0.0, "duration": 9.0, "text": "a"}, {"start": 2.0, "duration": 1.0, "text": "b"}]))
    r = readers.caption_spans(spark, str(tmp_path / "c")).orderBy("start_sec").collect()
    assert [(x.start_sec, x.end_sec) for x in r] == [(0.0, 2.0), (2.0, 3.0)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "v.json").write_text("[[101, 199], [0, 99]]")
    assert [(x.shot_id, x.start_frame) for x in readers.shot_lists(spark, str(tmp_path / "s")).orderBy("shot_id").collect()] == [(0, 0), (1, 101)]
    (tmp_path / "e.jsonl").write_text('{"video_id": "v", "keyframe_n": 1, "caption": "old"}\n{"video_id": "v", "keyframe_n": 1, "caption": "new"}\n{"video_id": "v", "keyf\n{"video_id": "w", "keyframe_n": 2}\n')
    assert [(x.video_id, x.caption) for x in readers.enrichment_lines(spark, str(tmp_path / "e.jsonl")).collect()] == [("v", "new")]


def test_captions_in_two_encodings(spark, tmp_path):
    (tmp_path / "v.csv").write_bytes("keyframe,response\n001.jpg,một con mèo\n".encode("utf-16"))
    (tmp_path / "w.csv").write_text("keyframe,response\n002.jpg,hai\n", encoding="utf-8")
    assert sorted((x.video_id, x.keyframe_n, x.caption) for x in readers.caption_csv(spark, str(tmp_path)).collect()) == [("v", 1, "một con mèo"), ("w", 2, "hai")]


def test_features_and_urls(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float16).reshape(2, 3))
    assert [(x.keyframe_n, x.v) for x in readers.feature_files(spark, str(tmp_path)).orderBy("keyframe_n").collect()] == [(1, [0, 1, 2]), (2, [3, 4, 5])]
    u = spark.createDataFrame([("https://a.example/watch?v=abc&x=1",), ("https://youtu.be/abcdefghijk",), ("none",)], "u string")
    assert [r.x for r in u.select(readers.video_url_id(u.u).alias("x")).collect()] == ["abc", "abcdefghijk", None]


def test_manifest_guards(spark, tmp_path):
    rows = spark.createDataFrame([("v", 0, 0, 9, 0.0, 1.0, "p")], CLIP)
    path = str(tmp_path / "m")
    writers.append_manifest(rows, path, "clip")
    writers.append_manifest(rows, path, "clip")
    assert readers.row_count(spark, path) == 2
    assert [r.video_id for r in readers.known_videos(spark, path).collect()] == ["v"]
    assert readers.known_videos(spark, path + "-none").count() == 0
    with pytest.raises(ValueError, match="lacks"):
        require_columns(rows.drop("path"), "clip")
    rows.drop("path").write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="columns"):
        writers.append_manifest(rows, str(tmp_path / "other"), "clip")


def test_collection_versions(spark, tmp_path):
    c = writers.Collection(spark, str(tmp_path / "col"))
    assert not c.exists()
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    c.create(rows)
    with pytest.raises(ValueError):
        c.create(rows)
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")
    c.upsert(new, ["id"])
    c.upsert(new, ["id"])
    assert sorted(map(tuple, c.current().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    c.compact(1)
    assert c.status()["rows"] == 3 and c.checksums().count() >= 1
    c.delete()
    assert not c.exists()
    assert writers.compatible("1.9.2", "1.9.4") and not writers.compatible("1.9.2", "1.8.9")


def test_streaming_upsert(spark, tmp_path):
    rows = spark.createDataFrame([("v", 0, 0, 9, 0.0, 1.0, "p"), ("v", 1, 10, 19, 1.0, 2.0, "p")], CLIP).selectExpr("*", "timestamp'2024-01-01' as ingested_at")
    src = tmp_path / "in"
    rows.write.parquet(str(src))
    c = writers.Collection(spark, str(tmp_path / "col"))
    for _ in range(2):
        ingest.merge_into(ingest.arriving(spark, str(src), "clip"), c, "clip", str(tmp_path / "ck")).awaitTermination()
    assert c.current().count() == 2
    rows.where("shot_id = 1").selectExpr("* except (path)", "concat(path, 'x') as path").select(*rows.columns).write.mode("append").parquet(str(src))
    ingest.merge_into(ingest.arriving(spark, str(src), "clip"), c, "clip", str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.path for r in c.current().collect()) == ["p", "px"]
