"""Manifest building, time joins, shots, checks and submissions over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions import scalar
from reelgrid.functions.text import clean, joined_texts, keep_region, nfc, quoted_spans, token_index, tokenize
from reelgrid.operators import etl, filters, manifests, shots, submit, temporal
from reelgrid.plans.search_queries import FRAMES, POINTS, SPEECH, frames_of, shots_of, speech_of, usable_points
from reelgrid.session import once_per_key, table
from reelgrid.sources import schemas

CLIPS = "c as (select * exclude (rn) from (select *, row_number() over (partition by video_id, shot_id order by ingested_at) as rn from clips) where rn = 1 and start_frame is not null and end_frame >= start_frame)"


def asof_snap(spark, d):
    """The shot of every keyframe; frames in a hole go to the following shot."""
    f = frames_of(spark, d).where("original_frame_id is not null").select("video_id", "keyframe_n", "original_frame_id")
    return temporal.shot_of_frame(f, shots_of(spark, d), "original_frame_id", "snap").select("video_id", "keyframe_n", "found_shot")


def asof_strict(spark, d):
    f = frames_of(spark, d).where("original_frame_id is not null").select("video_id", "keyframe_n", "original_frame_id")
    return temporal.shot_of_frame(f, shots_of(spark, d), "original_frame_id", "strict").select("video_id", "keyframe_n", "found_shot")


def asof_nearest(spark, d):
    """The shot at the middle of every speech segment, or the nearest."""
    s = speech_of(spark, d).select("video_id", "segment", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("at"))
    c = shots_of(spark, d).where("start_sec is not null and end_sec is not null")
    return temporal.nearest_shot(s, c, "at").select("video_id", "segment", "found_shot")


def inshot_nearest(spark, d):
    """Of each shot the keyframe nearest its middle among those inside; null if none is."""
    c = shots_of(spark, d).select("video_id", "shot_id", "start_sec", "end_sec")
    pairs = temporal.inside_window(c, frames_of(spark, d).select("video_id", "keyframe_n", "pts_sec"), ["video_id"], ("start_sec", "end_sec"), "pts_sec", 60.0)
    away = F.round(F.abs(F.col("pts_sec") - (F.col("start_sec") + F.col("end_sec")) / 2), 6)
    best = temporal.first_of(pairs.withColumn("away", away), ["video_id", "shot_id"], [F.col("away"), F.col("pts_sec"), F.col("keyframe_n")])
    return c.select("video_id", "shot_id").join(best.select("video_id", "shot_id", "keyframe_n"), ["video_id", "shot_id"], "left")


def overlap_semi(spark, d):
    """The shots that any speech overlaps, ends included."""
    c = shots_of(spark, d).select("video_id", "shot_id", "start_sec", "end_sec")
    s = speech_of(spark, d).select("video_id", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"))
    return temporal.overlapping_semi(c, s, ["video_id"], ["video_id", "shot_id"], ("start_sec", "end_sec"), ("a", "b"), 60.0).select("video_id", "shot_id")


def text_in_window(spark, d):
    c = shots_of(spark, d).select("video_id", "shot_id", F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    return temporal.texts_in_window(c, speech_of(spark, d).where("text_corrected is not null"), ["video_id", "shot_id"], ("lo", "hi"), "text_corrected")


def entities_in_window(spark, d):
    c = shots_of(spark, d).select("video_id", "shot_id", F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    e = temporal.entities_in_window(c, speech_of(spark, d), ["video_id", "shot_id"], ("lo", "hi"), "asr_persons")
    return e.select("video_id", "shot_id", F.concat_ws("|", "entities").alias("entities"))


def _series(spark, d):
    """A made-up transition score per keyframe, from whole numbers only."""
    f = frames_of(spark, d).select("video_id", "keyframe_n")
    first = f.groupBy("video_id").agg(F.min("keyframe_n").alias("first"))
    return f.join(first, "video_id").select("video_id", (F.col("keyframe_n") - F.col("first")).alias("frame"), ((F.col("keyframe_n") * 37) % 101 / 101).alias("score"))


def scenes_from_scores(spark, d):
    return shots.scenes_from_scores(_series(spark, d))


def merge_short_scenes(spark, d):
    return shots.merge_short_scenes(shots.scenes_from_scores(_series(spark, d)), 3)


def find_cuts(spark, d):
    return shots.find_cuts(_series(spark, d), 0.6, 4)


def _with_rate(spark, d):
    v = once_per_key(table(spark, d, "videos"), ["video_id"], None).select("video_id", "fps_num", "fps_den")
    return shots_of(spark, d).join(v, "video_id")


def plan_targets(spark, d):
    t = shots.plan_targets(F.col("start_frame"), F.col("end_frame"), F.col("fps_num") / F.col("fps_den"))
    return _with_rate(spark, d).select("video_id", "shot_id", F.explode(t).alias("target"))


def plan_windows(spark, d):
    t = shots.plan_targets(F.col("start_frame"), F.col("end_frame"), F.col("fps_num") / F.col("fps_den"), per_shot=6)
    w = F.explode(shots.plan_windows(F.col("start_frame"), F.col("end_frame"), t)).alias("w")
    return _with_rate(spark, d).select("video_id", "shot_id", w).select("video_id", "shot_id", "w.target", "w.low", "w.high")


def sharpest_frame(spark, d):
    """Of each window the keyframe with the most screen regions, as a stand-in for sharpness."""
    f = frames_of(spark, d, "ocr_regions").where("original_frame_id is not null").groupBy("video_id", F.col("original_frame_id").alias("frame")).agg(F.max("ocr_regions").cast("double").alias("sharpness")).where("sharpness is not null")
    t = F.transform(F.array((F.col("start_frame") + F.col("end_frame")) / 2), lambda x: F.floor(x))
    w = F.explode(shots.plan_windows(F.col("start_frame"), F.col("end_frame"), t, reach=40)).alias("w")
    windows = shots_of(spark, d).select("video_id", "shot_id", w).select("video_id", "shot_id", "w.target", "w.low", "w.high")
    return shots.sharpest_frames(windows, f)


def shot_coverage_check(spark, d):
    c = once_per_key(table(spark, d, "clips"), ["video_id", "shot_id"]).where("start_frame is not null and end_frame is not null")
    return shots.check_shots(c.select("video_id", "shot_id", "start_frame", "end_frame"), frames_of(spark, d).select("video_id", "shot_id", "original_frame_id"))


def frame_bounds(spark, d):
    return etl.frame_upper_bound(once_per_key(table(spark, d, "videos"), ["video_id"], None), frames_of(spark, d))


def _answers(spark, d):
    """Answers made of the frames of every shot's keyframes, numbered within their video."""
    f = frames_of(spark, d).where("original_frame_id is not null and shot_id is not null")
    rows = f.groupBy("video_id", "shot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("keyframe_n", "original_frame_id"))), lambda x: x["original_frame_id"]).alias("frame_ids"))
    return rows.withColumn("position", F.row_number().over(W.partitionBy("video_id").orderBy("shot_id")))


def submission_rows(spark, d):
    """The frames of every shot as an answer, checked against the bounds."""
    checked = submit.validate(_answers(spark, d), frame_bounds(spark, d))
    return checked.select("video_id", "shot_id", F.concat_ws(",", F.transform("frame_ids", lambda x: x.cast("string"))).alias("frames"), F.coalesce("reason", F.lit("ok")).alias("reason"))


def submission_lines(spark, d):
    """The lines of one submission a video for questions: the first frame of a shot and its screen text as the answer."""
    f = frames_of(spark, d, "ocr_text").where("keyframe_n <= 100 and original_frame_id is not null")
    rows = f.select("video_id", F.array("original_frame_id").alias("frame_ids"), F.col("keyframe_n").alias("position"), F.col("ocr_text").alias("answer"))
    return submit.csv_lines(rows)


def ocr_region_filter(spark, d):
    """Pieces of screen text that are kept, with their length as a stand-in for a score."""
    p = frames_of(spark, d, "ocr_text").select("video_id", "keyframe_n", F.posexplode(F.split("ocr_text", " · ")).alias("pos", "piece"))
    return p.where(keep_region(F.col("piece"), (F.length("piece") * 7 % 10) / 10)).select("video_id", "keyframe_n", "pos", "piece")


def ocr_by_shot(spark, d):
    """Every shot with the different pieces of its screen text, in the order of the keyframes, and how many."""
    p = frames_of(spark, d, "ocr_text").where("shot_id is not null").select("video_id", "shot_id", "keyframe_n", F.posexplode(F.split("ocr_text", " · ")).alias("pos", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    return etl.with_shot_text(shots_of(spark, d).select("video_id", "shot_id"), etl.shot_text(p))


def quoted_spans_query(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(quoted_spans(F.col("text"))).alias("pos", "span"))


def objects_topset(spark, d):
    return etl.objects_of_shot(frames_of(spark, d, "objects").where("shot_id is not null"))


def caption_join(spark, d):
    """Every keyframe with the caption of its (video, keyframe), '' where there is none, and the caption's quoted words."""
    captions = frames_of(spark, d, "caption_vi").where("caption_vi is not null").select("video_id", "keyframe_n", F.col("caption_vi").alias("caption"))
    return etl.join_captions(frames_of(spark, d).select("video_id", "keyframe_n"), captions)


def text_coverage(spark, d):
    """Of every video how many keyframes have any text, and how much of it."""
    f = frames_of(spark, d, "caption_vi", "ocr_text").select("video_id", "keyframe_n", joined_texts(F.col("caption_vi"), F.col("ocr_text")).alias("text"))
    return f.groupBy("video_id").agg(F.count("*").alias("keyframes"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("characters"))


def lexical_enrichment(spark, d):
    """Points with the texts of their keyframe laid over their payload; points without any keep theirs."""
    points = table(spark, d, "frame_vectors").select("point_id", "video_id", "keyframe_n").distinct().withColumn("ocr_text", F.lit("")).withColumn("caption_vi", F.lit(""))
    texts = frames_of(spark, d, "ocr_text", "caption_vi").select("video_id", "keyframe_n", "ocr_text", "caption_vi")
    merged, _ = etl.merge_payload(points, texts, ["video_id", "keyframe_n"])
    return merged.select("point_id", "ocr_text", "caption_vi")


def merge_last_wins(spark, d):
    f = table(spark, d, "frames").select("video_id", "keyframe_n", "ocr_regions", "ingested_at")
    return etl.last_write_wins(f, ["video_id", "keyframe_n"], ["ingested_at", "ocr_regions"]).select("video_id", "keyframe_n", "ocr_regions", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("arrived"))


def payload_merge(spark, d):
    """Every segment's text laid over the screen text of the keyframe of its number, row by row."""
    old = frames_of(spark, d, "ocr_text").select("video_id", "keyframe_n", "ocr_text")
    merged, _ = etl.merge_payload(old, _segment_texts(spark, d), ["video_id", "keyframe_n"])
    return merged


def payload_orphans(spark, d):
    """The segments without a keyframe of their number."""
    old = frames_of(spark, d).select("video_id", "keyframe_n")
    return etl.merge_payload(old, _segment_texts(spark, d), ["video_id", "keyframe_n"])[1]


def _segment_texts(spark, d):
    return speech_of(spark, d).select("video_id", F.col("segment").alias("keyframe_n"), F.col("text_corrected").alias("ocr_text"))


def keyed_upsert(spark, d):
    """The videos with their codec in one spelling: rows of known codecs replace the old ones, the others stay."""
    old = table(spark, d, "videos").select("video_id", "codec", "width").distinct()
    new = old.where("codec is not null").select("video_id", F.lower("codec").alias("codec"))
    return etl.keyed_upsert(old, new, ["video_id"])


def mean_pool_clip(spark, d):
    """All 96 numbers of every shot's mean vector."""
    v = usable_points(spark, d).join(frames_of(spark, d).select("video_id", "keyframe_n", "shot_id"), ["video_id", "keyframe_n"]).where("shot_id is not null")
    p = etl.mean_pool(v, ["video_id", "shot_id"], "v").where("v is not null")
    return p.select("video_id", "shot_id", "n", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 5) + 0.0)


def point_id_hex(spark, d):
    f = frames_of(spark, d)
    return f.select("video_id", "keyframe_n", scalar.point_id_hex(F.lit("frame"), F.col("video_id"), F.col("keyframe_n")).alias("point_id"))


def point_id_number(spark, d):
    """Ids of keyframes as unsigned numbers."""
    return frames_of(spark, d).select("video_id", "keyframe_n", scalar.point_id(F.lit("frame"), F.col("video_id"), F.col("keyframe_n")).cast("string").alias("point_id"))


def token_indexes(spark, d):
    """The index of every different token of the captions."""
    t = table(spark, d, "frames").where("caption_vi is not null").select(nfc("caption_vi").alias("t")).distinct()
    return t.select(F.explode(tokenize(F.col("t"))).alias("token")).distinct().withColumn("token_index", token_index(F.col("token")))


def frame_seconds(spark, d):
    """Seconds of frames and back, exactly by the rational rate."""
    v = once_per_key(table(spark, d, "videos"), ["video_id"], None).select("video_id", "fps_num", "fps_den")
    f = frames_of(spark, d).where("original_frame_id is not null").join(v, "video_id")
    sec = scalar.frame_to_sec(F.col("original_frame_id"), F.col("fps_num"), F.col("fps_den"))
    return f.select("video_id", "keyframe_n", F.round(sec, 6).alias("sec"), scalar.sec_to_frame(sec, F.col("fps_num"), F.col("fps_den")).alias("frame"))


def drift_stats(spark, d):
    """Of each video the median, 95th (by position) and largest difference between a frame's time and its number over the rate."""
    v = once_per_key(table(spark, d, "videos"), ["video_id"], None).select("video_id", "fps_num", "fps_den")
    f = frames_of(spark, d).where("original_frame_id is not null and pts_sec is not null").join(v, "video_id")
    x = f.select("video_id", F.round(F.abs(F.col("pts_sec") - F.col("original_frame_id") * F.col("fps_den") / F.col("fps_num")), 4).alias("drift"))
    p95 = etl.nearest_rank(x, ["video_id"], "drift", 0.95).withColumnRenamed("drift", "p95")
    return x.groupBy("video_id").agg(F.round(F.median("drift"), 5).alias("middle"), F.max("drift").alias("largest")).join(p95, "video_id")


def transcript_choice(spark, d):
    return etl.pick_transcript(table(spark, d, "transcripts").select("video_id", "transcript_id", "is_generated").distinct()).select("video_id", "transcript_id", "is_generated")


def transcript_report(spark, d):
    t = once_per_key(table(spark, d, "transcripts").select("transcript_id", "language_code", "is_generated", "duration_sec", "fetched_at"), ["transcript_id"], "fetched_at")
    return t.groupBy(F.lower(F.coalesce("language_code", F.lit("?"))).alias("language"), F.coalesce(F.col("is_generated").cast("string"), F.lit("?")).alias("generated")).agg(F.count("*").alias("transcripts"), F.round(F.sum("duration_sec") / 3600, 6).alias("hours"))


def clean_entities(spark, d):
    """Names of each segment without those that mean no value, once each in order."""
    s = speech_of(spark, d)
    n = etl.clean_names(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("asr_persons", "asr_orgs", "asr_locations")]))
    return s.select("video_id", "segment", F.concat_ws("|", n).alias("names")).where("names <> ''")


def invalid_rows(spark, d):
    """Rows that break a rule of their entity, counted by reason."""
    parts = []
    for name, entity in (("clips", "clip"), ("asr_segments", "asr_segment"), ("frames", "frame"), ("videos", "video")):
        parts.append(schemas.invalid_rows(schemas.require_columns(table(spark, d, name), entity), entity).groupBy("reason").agg(F.count("*").alias("rows")).withColumn("entity", F.lit(entity)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_titles(spark, d):
    s = speech_of(spark, d)
    return s.groupBy(clean(F.col("author")).alias("author")).agg(F.count("*").alias("segments"), F.countDistinct("video_id").alias("videos"))


def keyframes_per_shot(spark, d):
    c = shots_of(spark, d).select("video_id", "shot_id")
    n = frames_of(spark, d).groupBy("video_id", "shot_id").agg(F.count("*").alias("n"))
    return c.join(n, ["video_id", "shot_id"], "left").select("video_id", "shot_id", F.coalesce("n", F.lit(0)).alias("keyframe_count"))


def timeline(spark, d):
    """The keyframes of every video in order, each with the time to the next one in its video."""
    return temporal.with_time_to_next(frames_of(spark, d).where("pts_sec is not null").select("video_id", "keyframe_n", "shot_id", "pts_sec"))


def filtered_frames(spark, d):
    """Frames of some videos that show a person or a car and hold two words on screen, in one hour."""
    f = frames_of(spark, d, "objects", "ocr_text")
    f = filters.in_list(f, "video_id", table(spark, d, "videos").where("is_vfr = false").select("video_id"))
    return f.where(filters.has_any(F.col("objects"), ["person", "car"]) & filters.within(F.col("pts_sec"), 0, 3600) & (filters.has_words(F.col("ocr_text"), "số") | filters.has_words(F.col("ocr_text"), "TRỰC tiếp"))).select("video_id", "keyframe_n")


def segment_payload(spark, d):
    """The payload of every segment as JSON: only what carries something, but always the key and the times."""
    s = speech_of(spark, d).select("video_id", "segment", "start_sec", "end_sec", "text_corrected", "asr_persons")
    payload = etl.non_empty_payload(["video_id", "segment", "start_sec", "text_corrected", "asr_persons"], keep=("video_id", "segment", "start_sec"))
    return s.select("video_id", "segment", F.get_json_object(payload, "$.text_corrected").alias("text"), F.array_size(F.from_json(F.get_json_object(payload, "$.asr_persons"), "array<string>")).alias("persons"), F.get_json_object(payload, "$.segment").cast("int").alias("n"))


def keyframe_manifest(spark, d):
    """The keyframe manifest from file names, without a shot list: each keyframe is a shot of its own."""
    files = frames_of(spark, d).where("original_frame_id is not null").select("video_id", "original_frame_id", F.format_string("%s_%06d.jpg", "video_id", "original_frame_id").alias("path")).distinct()
    m = manifests.keyframe_manifest(files, _constant_rate(spark, d), fallback=(25, 1))
    return m.select("video_id", "shot_id", "keyframe_n", "original_frame_id", F.round("pts_sec", 6).alias("pts_sec"), "path")


def _constant_rate(spark, d):
    return once_per_key(table(spark, d, "videos"), ["video_id"], None).where("not coalesce(is_vfr, false)").select("video_id", "path", "fps_num", "fps_den", "is_vfr")


def shot_manifest(spark, d):
    """The shot manifest of the shot lists, with times by the rate of the video."""
    m = manifests.shot_manifest(shots_of(spark, d).select("video_id", "shot_id", "start_frame", "end_frame"), _constant_rate(spark, d), fallback=(25, 1))
    return m.select("video_id", "shot_id", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "path")


def clip_frames(spark, d):
    """The keyframes that stand for four evenly spaced times of every shot."""
    f = frames_of(spark, d).where("original_frame_id is not null and pts_sec is not null").select("video_id", F.col("original_frame_id").alias("frame"), F.col("pts_sec").alias("at_sec"))
    return manifests.sampled_frames(shots_of(spark, d).where("start_sec is not null and end_sec >= start_sec"), f, 4)


NAMES = [asof_snap, asof_strict, asof_nearest, inshot_nearest, overlap_semi, text_in_window, entities_in_window, scenes_from_scores, merge_short_scenes, find_cuts, plan_targets, plan_windows, sharpest_frame, shot_coverage_check, frame_bounds, submission_rows, submission_lines, ocr_region_filter, ocr_by_shot, objects_topset, caption_join, text_coverage, lexical_enrichment, merge_last_wins, payload_merge, payload_orphans, keyed_upsert, mean_pool_clip, point_id_hex, point_id_number, token_indexes, frame_seconds, drift_stats, transcript_choice, transcript_report, clean_entities, invalid_rows, clean_titles, keyframes_per_shot, timeline, filtered_frames, segment_payload, keyframe_manifest, shot_manifest, clip_frames]
QUERIES = {f.__name__: f for f in NAMES} | {"quoted_spans": quoted_spans_query}


def _w(*parts: str) -> str:
    return "with " + ",\n".join(parts) + " "


_SHOT_ORDER = "cs as (select *, row_number() over (partition by video_id order by start_frame, end_frame, shot_id) as pos, lead(shot_id) over (partition by video_id order by start_frame, end_frame, shot_id) as next_id from c)"
_ASOF = """j as (select f.video_id, f.keyframe_n, f.original_frame_id as fr, cs.*, row_number() over (partition by f.video_id, f.keyframe_n order by cs.pos desc nulls last) as r
  from f left join cs on f.video_id = cs.video_id and cs.start_frame <= f.original_frame_id where f.original_frame_id is not null)"""
_SERIES = "sr as (select video_id, keyframe_n - min(keyframe_n) over (partition by video_id) as frame, ((keyframe_n * 37) % 101) / 101 as score from f)"
_SCENES = f"""{_SERIES},
fl as (select *, score > 0.5 as o, coalesce(lag(score > 0.5) over (partition by video_id order by frame), false) as b from sr),
cl as (select video_id, frame from fl where o and not b and frame <> 0 union select video_id, max(frame) from sr group by video_id),
sc as (select video_id, coalesce(lag(frame) over (partition by video_id order by frame), -1) + 1 as start_frame, frame as end_frame from cl)"""
_RATED = "rt as (select c.*, v.fps_num, v.fps_den, v.fps_num / v.fps_den as fps from c join (select distinct video_id, fps_num, fps_den from videos) v using (video_id))"
_TARGETS = """t0 as (select *, end_frame - start_frame + 1 as len, cast(floor((end_frame - start_frame + 1) * 0.1) as bigint) as off from rt),
t1 as (select *, case when end_frame - off < start_frame + off then (start_frame + end_frame) // 2 else start_frame + off end as lo, case when end_frame - off < start_frame + off then (start_frame + end_frame) // 2 else end_frame - off end as hi from t0),
t2 as (select *, least({want}, hi - lo + 1) as n from t1),
t3 as (select distinct video_id, shot_id, start_frame, end_frame, lo + cast(floor((p + 0.5) * (hi - lo + 1) / n) as bigint) as target from (select *, unnest(range(cast(n as bigint))) as p from t2))"""
_EMPTY = "('', 'nan', 'none', 'null')"
_QUOTED = """list_filter(list_transform(regexp_extract_all({t}, '"[^"]{{2,160}}"|“[^”]{{2,160}}”'), lambda x: regexp_replace(substr(x, 2, length(x) - 2), '^\\s+|\\s+$', '', 'g')),
  lambda x: length(x) >= 2 and len(list_filter(['không rõ', 'không thể', 'không đọc', 'không nhìn', 'mờ', 'bị che'], lambda h: contains(lower(x), h))) = 0)"""
_WORDS = "regexp_extract_all(lower(coalesce(ocr_text, '')), '[\\p{L}\\p{M}\\p{N}_]+')"

SQL = {
    "asof_snap": _w(FRAMES, CLIPS, _SHOT_ORDER, _ASOF) + "select j.video_id, j.keyframe_n, case when j.shot_id is null then o.shot_id when fr <= end_frame then j.shot_id else coalesce(next_id, j.shot_id) end as found_shot from j left join (select video_id, shot_id from cs where pos = 1) o on o.video_id = j.video_id where r = 1",
    "asof_strict": _w(FRAMES, CLIPS, _SHOT_ORDER, _ASOF) + "select video_id, keyframe_n, case when fr <= end_frame then shot_id end as found_shot from j where r = 1",
    "asof_nearest": _w(SPEECH, CLIPS) + """, cs as (select *, row_number() over (w) as pos, lead(shot_id) over (w) as ni, lead(start_sec) over (w) as ns, lead(end_sec) over (w) as ne from c where start_sec is not null and end_sec is not null window w as (partition by video_id order by start_sec, end_sec, shot_id)),
m as (select video_id, segment, (start_sec + end_sec) / 2 as mid from s),
j as (select m.video_id, m.segment, m.mid, cs.* exclude (video_id), row_number() over (partition by m.video_id, m.segment order by pos desc nulls last) as r from m left join cs on cs.video_id = m.video_id and cs.start_sec <= m.mid)
select j.video_id, j.segment, case when mid is null then null when j.shot_id is null then o.shot_id when mid <= end_sec then j.shot_id when least(abs(mid - ns), abs(mid - ne)) < least(abs(mid - start_sec), abs(mid - end_sec)) then ni else j.shot_id end as found_shot
from j left join (select video_id, shot_id from cs where pos = 1) o on o.video_id = j.video_id where r = 1""",
    "inshot_nearest": _w(FRAMES, CLIPS) + "select c.video_id, c.shot_id, b.keyframe_n from c left join (select * from (select c.video_id, c.shot_id, f.keyframe_n, row_number() over (partition by c.video_id, c.shot_id order by round(abs(pts_sec - (c.start_sec + c.end_sec) / 2), 6), pts_sec, f.keyframe_n) as r from c join f on f.video_id = c.video_id and pts_sec between c.start_sec and c.end_sec) where r = 1) b on b.video_id = c.video_id and b.shot_id = c.shot_id",
    "overlap_semi": _w(SPEECH, CLIPS) + "select c.video_id, c.shot_id from c where c.end_sec >= c.start_sec and exists (select 1 from s where s.video_id = c.video_id and s.end_sec >= s.start_sec and s.start_sec <= c.end_sec and s.end_sec >= c.start_sec)",
    "text_in_window": _w(SPEECH, CLIPS) + "select c.video_id, c.shot_id, string_agg(text_corrected, ' ' order by s.start_sec, segment) as joined from c join s on s.video_id = c.video_id and s.end_sec >= s.start_sec and c.end_sec >= c.start_sec and s.start_sec < c.end_sec and s.end_sec > c.start_sec where text_corrected is not null group by all",
    "entities_in_window": _w(SPEECH, CLIPS) + """, j as (select c.video_id, c.shot_id, s.start_sec as a, s.segment, s.asr_persons as l from c join s on s.video_id = c.video_id and s.end_sec >= s.start_sec and c.end_sec >= c.start_sec and s.start_sec < c.end_sec and s.end_sec > c.start_sec),
e as (select video_id, shot_id, a, segment, unnest(l) as n, generate_subscripts(l, 1) as i from j), u as (select video_id, shot_id, n, min((a, segment, i)) as o from e where n is not null group by all),
k as (select distinct video_id, shot_id from j)
select k.video_id, k.shot_id, coalesce(string_agg(n, '|' order by o), '') as entities from k left join u using (video_id, shot_id) group by all""",
    "scenes_from_scores": _w(FRAMES, _SCENES) + "select * from sc where start_frame <= end_frame",
    "merge_short_scenes": _w(FRAMES, _SCENES) + """, n as (select *, row_number() over (partition by video_id order by start_frame) as k from sc where start_frame <= end_frame),
g as (select *, sum(case when end_frame - start_frame + 1 >= 3 or k = 1 then 1 else 0 end) over (partition by video_id order by start_frame) as g from n),
m as (select video_id, g, min(start_frame) as a, max(end_frame) as b from g group by all),
h as (select *, case when g = 2 and first_value(b - a + 1) over (partition by video_id order by a) < 3 then 1 else g end as h from m)
select video_id, min(a) as start_frame, max(b) as end_frame from h group by video_id, h""",
    "find_cuts": "with recursive " + FRAMES + ", " + _SERIES + """, c as (select video_id, frame from sr where score >= 0.6),
w(video_id, frame) as (select video_id, min(frame) from c where frame >= 4 group by video_id union all select w.video_id, (select min(c.frame) from c where c.video_id = w.video_id and c.frame >= w.frame + 4) from w where w.frame is not null)
select video_id, frame from w where frame is not null""",
    "plan_targets": _w(CLIPS, _RATED, _TARGETS.format(want="greatest(1, round_even(len / fps, 0))")) + "select video_id, shot_id, target from t3",
    "sharpest_frame": _w(FRAMES, CLIPS) + """, g as (select video_id, original_frame_id as frame, cast(max(ocr_regions) as double) as sharpness from f where original_frame_id is not null group by all having max(ocr_regions) is not null),
w as (select video_id, shot_id, (start_frame + end_frame) // 2 as target, start_frame, end_frame from c),
h as (select w.video_id, w.shot_id, w.target, g.frame, g.sharpness, row_number() over (partition by w.video_id, w.shot_id order by g.sharpness desc, g.frame) as r from w join g on g.video_id = w.video_id and g.frame between greatest(start_frame, target - 40) and least(end_frame, target + 40)) select video_id, shot_id, target, frame, sharpness from h where r = 1""",
    "shot_coverage_check": _w(FRAMES) + """, c as (select video_id, shot_id, start_frame, end_frame from (select *, row_number() over (partition by video_id, shot_id order by ingested_at) as rn from clips) where rn = 1 and start_frame is not null and end_frame is not null),
n as (select *, lead(start_frame) over (partition by video_id order by start_frame, shot_id) as ns from c), s as (select video_id, count(*) as shots, count(*) filter (end_frame < start_frame) as rev, count(*) filter (ns <= end_frame) as ov, max(end_frame) as e from n group by all),
k as (select video_id, count(*) as keyframes, max(original_frame_id) as last from f group by all), l as (select video_id, count(*) as missing_shots from f where shot_id is not null and not exists (select 1 from c where c.video_id = f.video_id and c.shot_id = f.shot_id) group by all),
cs as (select *, row_number() over (partition by video_id order by start_frame, end_frame, shot_id) as pos from c),
h as (select f.video_id, f.keyframe_n, f.original_frame_id as fr, cs.end_frame, row_number() over (partition by f.video_id, f.keyframe_n order by cs.pos desc nulls last) as r from f left join cs on f.video_id = cs.video_id and cs.start_frame <= f.original_frame_id where f.original_frame_id is not null),
u as (select video_id, count(*) filter (end_frame is null or fr > end_frame) as outside from h where r = 1 group by all)
select video_id, coalesce(shots, 0) as shots, coalesce(rev, 0) as "reversed", coalesce(ov, 0) as "overlaps", coalesce(keyframes, 0) as keyframes, coalesce(outside, 0) as outside, coalesce(greatest(last - e, 0), 0) as tail_gap, coalesce(missing_shots, 0) as missing_shots, case when shots is null then 'frames' when keyframes is null then 'shots' else 'both' end as only_in from s full join k using (video_id) left join u using (video_id) left join l using (video_id)""",
    "frame_bounds": _w(FRAMES) + ", m as (select video_id, max(original_frame_id) as x from f group by all) select v.video_id, greatest(cast(floor(floor(duration_sec) * fps_num / fps_den) as bigint), x + 1) as frame_upper_bound from (select distinct * from videos) v left join m using (video_id)",
    "ocr_region_filter": _w(FRAMES) + ", e as (select video_id, keyframe_n, unnest(string_split(ocr_text, ' · ')) as piece, generate_subscripts(string_split(ocr_text, ' · '), 1) - 1 as pos from f where ocr_text is not null) select video_id, keyframe_n, cast(pos as int) as pos, piece from e where case when length(trim(piece)) < 3 then false when length(trim(piece)) <= 4 then (length(piece) * 7 % 10) / 10 >= 0.5 else true end",
    "ocr_by_shot": _w(FRAMES, CLIPS) + """, e as (select video_id, shot_id, keyframe_n, trim(unnest(string_split(ocr_text, ' · ')), ' ') as piece, generate_subscripts(string_split(ocr_text, ' · '), 1) as i from f where shot_id is not null and ocr_text is not null),
u as (select video_id, shot_id, piece, min((keyframe_n, i)) as o from e where piece <> '' group by all), t as (select video_id, shot_id, string_agg(piece, ' ' order by o) as t, count(*) as n from u group by all)
select c.video_id, c.shot_id, coalesce(t, '') as ocr_text, coalesce(n, 0) as ocr_regions from c left join t using (video_id, shot_id)""",
    "objects_topset": _w(FRAMES) + ", e as (select video_id, shot_id, unnest(list_distinct(objects)) as object from f where shot_id is not null) select video_id, shot_id, object, count(*) as n from e group by all",
    "caption_join": _w(FRAMES) + f", x as (select video_id, keyframe_n, coalesce(caption_vi, '') as caption_vi, {_QUOTED.format(t='caption_vi')} as l from f) select video_id, keyframe_n, caption_vi, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' '), '') as ocr_text_vlm from x",
    "text_coverage": _w(FRAMES) + ", x as (select video_id, nullif(concat_ws(' · ', nullif(trim(caption_vi), ''), nullif(trim(ocr_text), '')), '') as t from f) select video_id, count(*) as keyframes, count(t) as with_text, cast(sum(length(t)) as bigint) as characters from x group by all",
    "lexical_enrichment": _w(FRAMES) + "select p.point_id, coalesce(f.ocr_text, '') as ocr_text, coalesce(f.caption_vi, '') as caption_vi from (select distinct point_id, video_id, keyframe_n from frame_vectors) p left join f using (video_id, keyframe_n)",
    "merge_last_wins": "select video_id, keyframe_n, ocr_regions, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') as arrived from (select *, row_number() over (partition by video_id, keyframe_n order by ingested_at desc, ocr_regions desc) as r from frames) where r = 1",
    "payload_merge": _w(FRAMES, SPEECH) + "select f.video_id, f.keyframe_n, coalesce(s.text_corrected, f.ocr_text) as ocr_text from f left join s on s.video_id = f.video_id and s.segment = f.keyframe_n",
    "payload_orphans": _w(FRAMES, SPEECH) + "select video_id, segment as keyframe_n, text_corrected as ocr_text from s where not exists (select 1 from f where f.video_id = s.video_id and f.keyframe_n = s.segment)",
    "keyed_upsert": "with n as (select video_id, lower(codec) as codec, null::int as width from (select distinct video_id, codec from videos) where codec is not null) select distinct video_id, codec, width from videos where video_id not in (select video_id from n) union all select * from n",
    "mean_pool_clip": _w(FRAMES, POINTS) + """, pv as (select list_transform(p.v, lambda x: x / sqrt(list_inner_product(p.v, p.v))) as v, f.video_id, f.shot_id from p join f on p.video_id = f.video_id and p.keyframe_n = f.keyframe_n where f.shot_id is not null), pe as (select video_id, shot_id, unnest(v) as x, generate_subscripts(v, 1) - 1 as i from pv),
pa as (select video_id, shot_id, i, avg(x) as x, count(*) as n from pe group by all), pl as (select video_id, shot_id, sqrt(sum(x * x)) as l from pa group by all)
select video_id, shot_id, n, cast(i as int) as i, round(x / l, 5) + 0.0 as x from pa join pl using (video_id, shot_id) where l > 0""",
    "point_id_hex": _w(FRAMES) + "select video_id, keyframe_n, substr(sha1('frame:' || video_id || ':' || keyframe_n), 1, 16) as point_id from f",
    "frame_seconds": _w(FRAMES) + "select f.video_id, keyframe_n, round(original_frame_id * fps_den / fps_num, 6) as sec, original_frame_id as frame from f join (select distinct video_id, fps_num, fps_den from videos) v on v.video_id = f.video_id where original_frame_id is not null",
    "drift_stats": _w(FRAMES) + """, x as (select f.video_id, round(abs(pts_sec - original_frame_id * fps_den / fps_num), 4) as drift from f join (select distinct video_id, fps_num, fps_den from videos) v on v.video_id = f.video_id where original_frame_id is not null and pts_sec is not null),
n as (select *, row_number() over (partition by video_id order by drift) - 1 as p, count(*) over (partition by video_id) as c from x) select video_id, round(median(drift), 5) as middle, max(drift) as largest, max(drift) filter (p = least(floor(c * 0.95), c - 1)) as p95 from n group by all""",
    "transcript_choice": "select video_id, transcript_id, is_generated from (select *, row_number() over (partition by video_id order by case when not is_generated then 0 when is_generated then 1 else 2 end, transcript_id) as r from (select distinct video_id, transcript_id, is_generated from transcripts)) where r = 1",
    "transcript_report": "with t as (select distinct transcript_id, language_code, is_generated, duration_sec from transcripts) select lower(coalesce(language_code, '?')) as language, coalesce(cast(is_generated as varchar), '?') as generated, count(*) as transcripts, round(sum(duration_sec) / 3600, 6) as hours from t group by all",
    "clean_entities": _w(SPEECH) + f", l as (select video_id, segment, list_concat(list_concat(coalesce(asr_persons, []), coalesce(asr_orgs, [])), coalesce(asr_locations, [])) as l from s), e as (select video_id, segment, trim(unnest(l)) as n, generate_subscripts(l, 1) as i from l), u as (select video_id, segment, n, min(i) as i from e where n is not null and lower(n) not in {_EMPTY} group by all) select video_id, segment, string_agg(n, '|' order by i) as names from u group by all",
    "invalid_rows": """with r as (select 'clip' as entity, case when video_id is null or shot_id is null then 'null key' when end_frame < start_frame then 'end before start' when start_frame < 0 then 'negative frame' end as reason from clips
union all select 'asr_segment', case when video_id is null or segment is null then 'null key' when end_sec < start_sec then 'end before start' when start_sec < 0 then 'negative time' end from asr_segments
union all select 'frame', case when video_id is null or keyframe_n is null then 'null key' when keyframe_n < 1 then 'keyframe below 1' when original_frame_id < 0 then 'negative frame' end from frames
union all select 'video', case when video_id is null then 'null key' when coalesce(rotation, 0) not in (0, 90, 180, 270) then 'rotation' when fps_num <= 0 or fps_den <= 0 then 'rate' end from videos) select entity, reason, count(*) as rows from r where reason is not null group by all""",
    "clean_titles": _w(SPEECH) + f"select case when author is null or lower(trim(author)) in {_EMPTY} then '' else trim(author) end as author, count(*) as segments, count(distinct video_id) as videos from s group by 1",
    "keyframes_per_shot": _w(FRAMES, CLIPS) + "select c.video_id, c.shot_id, count(f.keyframe_n) as keyframe_count from c left join f on f.video_id = c.video_id and f.shot_id = c.shot_id group by all",
    "timeline": _w(FRAMES) + "select video_id, keyframe_n, shot_id, pts_sec, round(lead(pts_sec) over (partition by video_id order by pts_sec, keyframe_n) - pts_sec, 6) as to_next from f where pts_sec is not null",
    "filtered_frames": _w(FRAMES) + f"select video_id, keyframe_n from f where video_id in (select video_id from videos where not is_vfr) and len(list_intersect(objects, ['person', 'car'])) > 0 and pts_sec between 0 and 3600 and (list_contains({_WORDS}, 'số') or (list_contains({_WORDS}, 'trực') and list_contains({_WORDS}, 'tiếp')))",
    "segment_payload": _w(SPEECH) + "select video_id, segment, nullif(text_corrected, '') as text, case when len(asr_persons) > 0 then len(asr_persons)::int end as persons, segment as n from s",
    "keyframe_manifest": _w(FRAMES) + """, k as (select distinct video_id, original_frame_id from f where original_frame_id is not null), v as (select distinct video_id, fps_num, fps_den from videos where not coalesce(is_vfr, false))
select video_id, row_number() over (w) - 1 as shot_id, row_number() over (w) as keyframe_n, original_frame_id, round(original_frame_id * coalesce(fps_den, 1) / coalesce(fps_num, 25), 6) as pts_sec, printf('%s_%06d.jpg', video_id, original_frame_id) as path from k left join v using (video_id) window w as (partition by video_id order by original_frame_id)""",
    "shot_manifest": _w(CLIPS) + ", v as (select distinct video_id, path, fps_num, fps_den from videos where not coalesce(is_vfr, false)) select c.video_id, c.shot_id, round(start_frame * coalesce(fps_den, 1) / coalesce(fps_num, 25), 6) as start_sec, round(end_frame * coalesce(fps_den, 1) / coalesce(fps_num, 25), 6) as end_sec, coalesce(v.path, c.video_id) as path from c left join v using (video_id)",
    "clip_frames": _w(FRAMES, CLIPS) + """, b as (select *, case when end_frame > start_frame then (end_sec - start_sec) / (2 * (end_frame - start_frame)) else 0 end as half, least(4, end_frame - start_frame + 1) as n from c where start_sec is not null and end_sec >= start_sec),
m as (select b.*, f.pts_sec as t, {'t': f.pts_sec, 'frame': f.original_frame_id} as s from b join f on f.video_id = b.video_id and f.original_frame_id is not null and f.pts_sec + half >= b.start_sec and f.pts_sec - half <= b.end_sec),
x as (select *, case when i = 0 then start_sec when i = n - 1 then end_sec else start_sec + i * ((end_sec - start_sec) / (n - 1)) end as want from (select *, unnest(range(n)) as i from m))
select video_id, shot_id, cast(i as int) as position, coalesce(struct_extract(min(s) filter (t + half >= want), 'frame'), struct_extract(max(s), 'frame')) as frame from x group by all""",
    "submission_rows": _w(FRAMES) + """, m as (select video_id, max(original_frame_id) as x from f group by all), b as (select v.video_id, greatest(cast(floor(floor(duration_sec) * fps_num / fps_den) as bigint), x + 1) as u from (select distinct * from videos) v left join m using (video_id)),
r as (select video_id, shot_id, list(original_frame_id order by keyframe_n) as l from f where shot_id is not null and original_frame_id is not null group by all)
select r.video_id, shot_id, array_to_string(l, ',') as frames, case when b.video_id is null then 'unknown video' when list_max(l) >= u then 'frame out of bounds' when len(list_filter(range(1, len(l)), lambda i: l[i] >= l[i + 1])) > 0 then 'frames not rising' else 'ok' end as reason from r left join b using (video_id)""",
    "submission_lines": _w(FRAMES) + """, a as (select keyframe_n as position, video_id, original_frame_id as fr, trim(regexp_replace(ocr_text, '\\s+', ' ', 'g'), ' ') as t from f where keyframe_n <= 100 and original_frame_id is not null)
select position, video_id || ',' || fr || case when t is null then '' when regexp_matches(t, '[",\\r\\n]') then ',"' || replace(t, '"', '""') || '"' else ',' || t end as line from a""",
    "point_id_number": _w(FRAMES) + "select video_id, keyframe_n, cast(cast('0x' || substr(sha1('frame:' || video_id || ':' || keyframe_n), 1, 16) as ubigint) as varchar) as point_id from f",
    "token_indexes": """with t as (select distinct unnest(list_filter(regexp_extract_all(lower(nfc_normalize(caption_vi)), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) <= 24)) as token from frames where caption_vi is not null),
b as (select token, hex(encode(token)) as h from t), y as (select token, list_transform(range(0, length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint)) as l from b)
select token, xor(list_reduce(l, lambda c, b: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) & 2147483647 as token_index from y""",
    "quoted_spans": f"""with q as (select doc_id, {_QUOTED.format(t='text')} as l from documents where text is not null),
e as (select doc_id, unnest(l) as span, generate_subscripts(l, 1) as i from q), u as (select doc_id, span, min(i) as i from e group by all) select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as pos, span from u""",
    "plan_windows": _w(CLIPS, _RATED, _TARGETS.format(want="6")) + """, h as (select *, least(end_frame, target + 2) as high, greatest(start_frame, target - 2, coalesce(max(least(end_frame, target + 2)) over (partition by video_id, shot_id order by target rows between unbounded preceding and 1 preceding), start_frame - 1) + 1) as low from t3) select video_id, shot_id, target, low, high from h where high >= low""",
}
