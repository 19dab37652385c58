from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import scalar, text
from reelgrid.functions.text import fold, numbered_lines, picture_sections, quoted_spans, snapshot_name
from reelgrid.operators import etl, evaluate, filters, manifests, shots, submit, temporal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def series(spark, scores):
    return spark.createDataFrame([("v", i, float(s)) for i, s in enumerate(scores)], "video_id string, frame int, score double")


def spans(df):
    return sorted((r.start_frame, r.end_frame) for r in df.collect())


def test_scenes(spark):
    flat = [0.0] * 100
    a, b = list(flat), list(flat)
    a[59] = 1
    b[40:46] = [1] * 6
    assert spans(shots.scenes_from_scores(series(spark, a))) == [(0, 59), (60, 99)]
    assert spans(shots.scenes_from_scores(series(spark, b))) == [(0, 40), (41, 99)]
    assert spans(shots.scenes_from_scores(series(spark, [1.0] + flat[1:]))) == [(0, 99)]


def scenes(spark, rows):
    return spark.createDataFrame([("v", a, b) for a, b in rows], "video_id string, start_frame int, end_frame int")


def test_merge_short(spark):
    assert spans(shots.merge_short_scenes(scenes(spark, [(0, 49), (50, 54), (55, 99)]))) == [(0, 54), (55, 99)]
    assert spans(shots.merge_short_scenes(scenes(spark, [(0, 4), (5, 99)]))) == [(0, 99)]


def test_cuts(spark):
    def cuts(rows):
        df = spark.createDataFrame([("v", i, float(s)) for i, s in rows], "video_id string, frame int, score double")
        return sorted(r.frame for r in shots.find_cuts(df).collect())

    assert cuts([(1, 2), (16, 90), (17, 2), (40, 90)]) == [16, 40]
    assert cuts([(i, 90) for i in range(20, 31)]) == [20]
    dense = list(range(3, 300, 2))
    want, last = [], 0
    for i in dense:
        if i - last >= 15:
            want.append(i)
            last = i
    assert cuts([(i, 90) for i in dense]) == want


def test_targets_and_windows(spark):
    t = lambda a, b, **k: one(spark, shots.plan_targets(F.lit(a), F.lit(b), F.lit(25.0), **k))
    assert len(t(0, 99)) == 4
    assert t(10, 11, per_shot=3) == [10, 11]
    assert len(t(0, 61)) == 2 and len(t(0, 62)) == 3  # 2.48 and 2.52 s
    w = one(spark, shots.plan_windows(F.lit(0), F.lit(99), F.array(F.lit(50), F.lit(52), F.lit(98)).cast("array<bigint>")))
    assert [(x.target, x.low, x.high) for x in w] == [(50, 48, 52), (52, 53, 54), (98, 96, 99)]


def test_tokens(spark):
    assert len(one(spark, text.tokenize(F.lit("Đồng bằng sông Cửu Long, 31/12/2025!")))) == 8
    assert one(spark, text.tokenize(F.lit("a" * 30))) == []
    assert one(spark, text.fold(F.lit("đường sụt lún"))) == "duong sut lun"
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []


def test_small_text_rules(spark):
    assert one(spark, text.clean(F.lit("  NaN "))) == ""
    assert one(spark, text.joined_texts(F.lit(" a "), F.lit(None).cast("string"), F.lit("b"))) == "a · b"
    assert one(spark, text.quoted_spans(F.lit('he said "so be it" and “không rõ chữ” and "so be it", "1 of 11"'))) == ["so be it", "1 of 11"]
    assert one(spark, text.event_markers(F.lit("E1: a b E2. c"))) == ["a b", "c"]
    assert one(spark, text.event_markers(F.lit("E1: alone"))) is None
    keep = lambda t, s: one(spark, text.keep_region(F.lit(t), F.lit(s)))
    assert [keep("ab", 0.9), keep("abc", 0.4), keep("abc", 0.5), keep("abcde", 0.0)] == [False, False, True, True]


def test_scalars(spark):
    import hashlib
    import zlib

    h = hashlib.sha1(b"frame:v:3").hexdigest()[:16]
    assert one(spark, scalar.point_id_hex(F.lit("frame"), F.lit("v"), F.lit(3))) == h
    assert int(one(spark, scalar.point_id(F.lit("frame"), F.lit("v"), F.lit(3)))) == int(h, 16)
    assert one(spark, text.token_index(F.lit("đường"))) == zlib.crc32("đường".encode()) & 0x7FFFFFFF
    assert one(spark, scalar.gap_penalty(F.lit(300.0))) == pytest.approx(1)
    assert one(spark, scalar.gap_penalty(F.lit(None).cast("double"))) == 0
    n = F.lit(None).cast("double")
    assert one(spark, scalar.time_window(F.lit(3.0), F.lit(3.0), n, n, F.lit(5.0), 1.0)).low == 4
    assert one(spark, scalar.sec_to_frame(F.lit(2.5), F.lit(1), F.lit(1))) == 2


def test_asof_modes(spark):
    s = spark.createDataFrame([("v", 0, 0, 99), ("v", 1, 101, 199), ("v", 2, 201, 299)], "video_id string, shot_id int, start_frame bigint, end_frame bigint")
    f = spark.createDataFrame([("v", x) for x in (50, 100, 200, 5000)] + [("u", 3), ("v", None)], "video_id string, fr bigint")
    for bucket in (50.0, 4000.0):
        snap = {r.fr: r.found_shot for r in temporal.shot_of_frame(f, s, "fr", "snap", bucket).where("video_id = 'v'").collect()}
        assert snap == {50: 0, 100: 1, 200: 2, 5000: 2, None: None}
        strict = {r.fr: r.found_shot for r in temporal.shot_of_frame(f, s, "fr", "strict", bucket).where("video_id = 'v'").collect()}
        assert strict == {50: 0, 100: None, 200: None, 5000: None, None: None}
    first = spark.createDataFrame([("v", 5, 10, 20)], "video_id string, shot_id int, start_frame bigint, end_frame bigint")
    assert temporal.shot_of_frame(f.where("fr = 50 or fr = 3"), first.selectExpr("video_id", "shot_id", "start_frame + 60 as start_frame", "end_frame + 60 as end_frame"), "fr").where("video_id = 'v'").first().found_shot == 5


def test_overlapping_pairs_once(spark):
    a = spark.createDataFrame([("v", 1, 0.0, 500.0), ("v", 2, 5.0, 1.0), (None, 3, 0.0, 1.0)], "k string, i int, a double, b double")
    b = spark.createDataFrame([("v", 7, 500.0, 900.0), ("v", 8, 100.0, 400.0), ("v", 9, None, 3.0)], "k string, j int, c double, d double")
    got = lambda closed: sorted((r.i, r.j) for r in temporal.overlapping(a, b, ["k"], ("a", "b"), ("c", "d"), 10.0, closed).collect())
    assert got(True) == [(1, 7), (1, 8)]
    assert got(False) == [(1, 8)]


def test_segments_to_frames(spark):
    f = spark.createDataFrame([("v", 1, 100, 4.0, 0.0, 10.0), ("v", 1, 150, 6.0, 0.0, 10.0)], "video_id string, shot_id int, frame_id bigint, pts_sec double, low double, high double")
    s = spark.createDataFrame([(1, "v", 1, 4.0, 6.0, 0.4), (1, "v", 2, 4.0, 6.0, 0.9)], "query_id bigint, video_id string, segment int, start_sec double, end_sec double, score double")
    r = temporal.segments_to_frames(s, f).collect()
    assert [(x.frame_id, x.segment) for x in r] == [(100, 2)]


def test_measures(spark):
    r = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 30)], "query_id int, rank int")
    m = evaluate.summarise(r).first()
    assert (m.recall_at_1, m.recall_at_5, m.recall_at_50, m.found) == (0.25, 0.5, 0.75, 3)
    assert m.mrr == pytest.approx((1 + 0.25 + 1 / 30) / 4)
    assert evaluate.summarise(r.where("rank = 77")).first().mrr == 0
    q = spark.createDataFrame([(1,)], "query_id int")
    for rank, want in ((100, 100), (101, None)):
        h = spark.createDataFrame([(1, rank, "v", 2)], "query_id int, rank int, video_id string, shot_id int")
        assert evaluate.rank_of(h, h.select("query_id", "video_id", "shot_id"), q).first()["rank"] == want


def test_best_window_takes_the_rare_words(spark):
    d = spark.createDataFrame([(1, "xin chào quý vị movistar vuelta"), (2, "ngắn")], "k int, t string")
    idf = spark.createDataFrame([("xin", 0.1), ("movistar", 3.0), ("vuelta", 2.0)], "token string, idf double")
    assert {r.k: r.best_text for r in evaluate.best_window(d, ["k"], "t", idf, 2).collect()} == {1: "movistar vuelta", 2: "ngắn"}


def test_submission_reasons(spark):
    b = spark.createDataFrame([("v", 100), ("w", None)], "video_id string, frame_upper_bound bigint")
    r = spark.createDataFrame([(1, "v", [1, 2]), (2, "v", [1, 100]), (3, "v", [5, 5]), (4, "x", [1]), (5, "w", [9999])], "position int, video_id string, frame_ids array<bigint>")
    assert [x.reason for x in submit.validate(r, b).orderBy("position").collect()] == [None, "frame out of bounds", "frames not rising", "unknown video", None]
    # No bounds at all: none are known, so nothing is out of them.
    assert [x.reason for x in submit.validate(r, b.limit(0)).orderBy("position").collect()] == [None, None, "frames not rising", None, None]


def test_submission_files(spark):
    r = spark.createDataFrame([(1, "L22_V001", [1200], None), (2, "L22_V001", [7], 'áo, "đỏ"\n xanh'), (3, "v", [1, 2, 3], None)], "position int, video_id string, frame_ids array<bigint>, answer string")
    assert [x.line for x in submit.csv_lines(r).orderBy("position").collect()] == ["L22_V001,1200", 'L22_V001,7,"áo, ""đỏ"" xanh"', "v,1,2,3"]
    assert json.loads(submit.as_json(r, "qa").first().submission)[1] == {"task": "qa", "fields": ["L22_V001", "7", 'áo, "đỏ" xanh']}
    for made in (submit.csv_lines, submit.as_json):
        with pytest.raises(Exception, match="at most 100 rows"):
            made(r.withColumn("position", F.col("position") + 98)).collect()


def test_detections_stop_at_the_first_weak_one(spark):
    m = one(spark, etl.detections(F.array(*map(F.lit, ["dog", "cat", "dog", "bus", "cow"])), F.array(*map(F.lit, [0.9, 0.8, 0.5, 0.2, 0.9]))))
    assert m == {"dog": 2, "cat": 1}


def test_mean_pool_of_unit_vectors(spark):
    rows = [(1, "a", [10.0, 0.0]), (1, "a", [0.0, 2.0]), (2, None, [0.0, 0.0]), (None, "c", [3.0, 4.0]), (None, "c", None), (4, "d", [1.0, 0.0]), (4, "d", [-1.0, 0.0])] + [(5, "e", [float(i % 7 + 1), 0.0]) for i in range(3000)]
    v = spark.createDataFrame(rows, "k int, l string, v array<double>").repartition(3)
    got = {(r.k, r.l): (r.n, r.v) for r in etl.mean_pool(v, ["k", "l"], "v").collect()}
    assert got[1, "a"][1] == pytest.approx([0.5**0.5, 0.5**0.5]) and got[None, "c"] == (1, [0.6, 0.8])
    assert got[4, "d"] == (2, None) and got[5, "e"] == (3000, [1.0, 0.0]) and (2, None) not in got and len(got) == 4
    assert etl.mean_pool(v.limit(0), ["k", "l"], "v").collect() == []


def test_quoted_spans(spark):
    text = 'Biển ghi "Chợ nổi" và “Bến phà”, chữ "không rõ chữ", "bị che", “mờ quá”, "Chợ nổi", “a'
    assert one(spark, quoted_spans(F.lit(text))) == ["Chợ nổi", "Bến phà"]


def test_answers_of_models(spark):
    assert one(spark, numbered_lines(F.lit("<think>9. no</think>\n2) “hai”\n\n1. một "))) == ["một", "hai"]
    for bad in ("1. một\n3. ba", "2. hai", "nothing", "1. \n2. hai", None):
        assert one(spark, numbered_lines(F.lit(bad))) is None
    assert one(spark, numbered_lines(F.lit("1. một"), F.lit(2))) is None
    s = one(spark, picture_sections(F.lit("x\nCHỮ:\nBến phà\nsố 4\nmô tả\nmột con\nmèo\n")))
    assert (s.text, s.caption) == ("Bến phà\nsố 4", "một con mèo")
    s = one(spark, picture_sections(F.lit("CHU\nKhông có chữ\nMO TA:\na")))
    assert (s.text, s.caption) == ("", "a")


def test_printed_dictionaries():
    got = etl.entity_lists("{'persons': [\"O'Neil\", 'A', 'A', 'nan'], 'orgs': 'x', 'locations': ('B',)}")
    assert got == {"persons": ["O'Neil", "A"], "orgs": [], "locations": ["B"]}
    assert etl.entity_lists("{'persons': [") == etl.entity_lists(None) == {"persons": [], "orgs": [], "locations": []}


def test_keyframe_manifest(spark):
    files = spark.createDataFrame([("v", f, f"{f}.jpg") for f in (45, 5, 15)] + [("w", 7, "7.jpg")], "video_id string, original_frame_id bigint, path string")
    videos = spark.createDataFrame([("v", 30000, 1001, False)], "video_id string, fps_num int, fps_den int, is_vfr boolean")
    own = manifests.keyframe_manifest(files, videos, fallback=(25, 1)).orderBy("video_id", "keyframe_n").collect()
    assert [(r.video_id, r.original_frame_id, r.shot_id) for r in own] == [("v", 5, 0), ("v", 15, 1), ("v", 45, 2), ("w", 7, 0)]
    assert own[0].pts_sec == pytest.approx(5 * 1001 / 30000) and own[3].pts_sec == 7 / 25
    shots = spark.createDataFrame([("v", 0, 0, 9), ("v", 1, 10, 39), ("v", 2, 40, 45)], "video_id string, shot_id int, start_frame bigint, end_frame bigint")
    got = manifests.keyframe_manifest(files.where("video_id = 'v'"), videos, shots).orderBy("keyframe_n").collect()
    assert [r.shot_id for r in got] == [0, 1, 2]
    for bad in (manifests.keyframe_manifest(files, videos), manifests.keyframe_manifest(files, videos, shots, (25, 1))):
        with pytest.raises(Exception, match="no frame rate for w|outside every shot"):
            bad.collect()


def test_clip_times(spark):
    t = lambda a, b, f, g, n: one(spark, manifests.sample_times(F.lit(a), F.lit(b), F.lit(f), F.lit(g), n))
    assert t(1.0, 4.0, 25, 100, 4) == [1.0, 2.0, 3.0, 4.0] and t(1.0, 1.0, 25, 25, 4) == [1.0] and t(1.0, 1.04, 25, 26, 4) == [1.0, 1.04]


def test_filters(spark):
    df = spark.createDataFrame([("a", 1.0, ["car"], "Sông Cửu Long", "01/02/2024"), ("b", None, None, None, None)], "video_id string, t double, objects array<string>, text string, publish_date string")
    names = lambda d: [r.video_id for r in d.collect()]
    assert names(filters.in_list(df, "video_id", [])) == names(filters.in_list(df, "video_id", None)) == ["a", "b"]
    assert names(filters.in_list(df, "video_id", ["b"])) == names(filters.in_list(df, "video_id", [*"bcdefghijklm"])) == names(filters.in_list(df, "video_id", df.where("t is null").select("video_id"))) == ["b"]
    assert names(filters.in_list(df, "video_id", df.limit(0).select("video_id"))) == []
    assert names(df.where(filters.within(F.col("t"), 0))) == names(df.where(filters.has_any(F.col("objects"), ["car", "bus"]))) == names(df.where(filters.has_words(F.col("text"), "long SÔNG"))) == ["a"]
    assert names(filters.by_meta(df, ["car"], published=("01/01/2024", None))) == ["a"] and names(filters.by_meta(df, published=(None, "31/01/2024"))) == []


def test_lengths_of_rewrites(spark):
    texts = F.array(F.lit("abcd"), F.lit("abc"))
    assert one(spark, scalar.caption_budget(texts)) == 192 and one(spark, scalar.clean_budget(texts)) == 131


def test_payload_keeps_what_carries_something(spark):
    df = spark.createDataFrame([("v", 0.0, "", [], 0, "t")], "video_id string, start_sec double, ocr_text string, objects array<string>, n int, title string")
    got = json.loads(df.select(etl.non_empty_payload(df.columns, keep=("start_sec",)).alias("p")).first().p)
    assert got == {"video_id": "v", "start_sec": 0.0, "title": "t"}


def test_small_scalars(spark):
    assert one(spark, scalar.clip_range(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(5), F.lit(10))).asDict() == {"start": 0, "end": 15}
    assert one(spark, scalar.clip_range(F.lit(1), F.lit(400), F.lit(None).cast("int"), F.lit(None).cast("int"))) is None
    assert one(spark, scalar.rotation(F.array(F.lit(0.0), F.lit(-1.0)))) == 90
    assert one(spark, snapshot_name(F.lit("a b/c"))).startswith("a_b_c-") and one(spark, fold(F.lit("ế̃ Đ"))) == "e D"


def test_variable_rate_is_refused(spark):
    v = spark.createDataFrame([("v", True)], "video_id string, is_vfr boolean")
    with pytest.raises(Exception, match="variable frame rate: v"):
        etl.refuse_variable_rate(v).collect()


def test_detected_shots(spark):
    s = spark.createDataFrame([("v", i, 90.0 if i in (16, 40) else 2.0) for i in range(60)], "video_id string, frame bigint, score double")
    v = spark.createDataFrame([("v", 10, 1, "p")], "video_id string, fps_num int, fps_den int, path string")
    got = [(r.shot_id, r.start_frame, r.end_frame, r.end_sec) for r in shots.detect_shots(s, v, "content").orderBy("shot_id").collect()]
    assert got == [(0, 0, 15, 1.5), (1, 16, 39, 3.9), (2, 40, 59, 5.9)]
    with pytest.raises(ValueError, match="no detector"):
        shots.detect_shots(s, v, "other")


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from reelgrid import session

    held = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://a:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session._shared_folder(held)


def test_a_segment_of_many_queries_meets_the_frames_once(spark, monkeypatch):
    """asr_nearest_frame (F3): each query's segments were joined with the frames, and frames with the same times each by itself."""
    f = spark.createDataFrame([("v", i % 3, 100 + i, 4.0 + i % 2, 0.0, 10.0) for i in range(40)], "video_id string, shot_id int, frame_id bigint, pts_sec double, low double, high double")
    s = spark.createDataFrame([(q, "v", g, 4.0, 6.0, g / 10) for q in range(30) for g in range(3)], "query_id bigint, video_id string, segment int, start_sec double, end_sec double, score double")
    met, overlapping = [], temporal.overlapping
    monkeypatch.setattr(temporal, "overlapping", lambda a, b, *x: met.append((a.count(), b.count())) or overlapping(a, b, *x))
    r = temporal.segments_to_frames(s, f).collect()
    assert sorted((x.query_id, x.frame_id, x.segment, x.score) for x in r) == [(q, 101, 2, 0.2) for q in range(30)]
    assert met == [(1, 2)]
