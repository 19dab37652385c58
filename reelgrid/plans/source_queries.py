"""Sources and sinks over the test tables: each query writes files of one kind from a whole table and reads them back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions.text import numbered_lines, picture_sections
from reelgrid.operators import etl, shots, submit
from reelgrid.plans.etl_queries import CLIPS
from reelgrid.plans.search_queries import FRAMES, SPEECH, frames_of, shots_of, speech_of
from reelgrid.session import once_per_key, scratch, table
from reelgrid.sources import readers, writers
from reelgrid.sources.schemas import ENTITIES


def _lists(c):
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def manifest_rows(spark, d):
    """A manifest written in two appends and read with its columns checked."""
    path, c = scratch(spark), shots_of(spark, d)
    writers.append_manifest(c.where("shot_id % 2 = 0"), path, "clip")
    writers.append_manifest(c.where("shot_id % 2 = 1"), path, "clip")
    return readers.manifest(spark, path, "clip")


def manifest_count(spark, d):
    """The number of rows by the files' footers."""
    path = scratch(spark)
    writers.append_manifest(once_per_key(table(spark, d, "videos"), ["video_id"], None), path, "video")
    return spark.createDataFrame([(readers.row_count(spark, path),)], "rows bigint")


def pending_videos(spark, d):
    """The videos whose shots no manifest has yet."""
    path = scratch(spark)
    writers.append_manifest(shots_of(spark, d), path, "clip")
    return readers.pending(table(spark, d, "videos").select("video_id").distinct(), readers.known_videos(spark, path))


def keyframe_map_csv(spark, d):
    """Keyframe maps, one CSV a video, with the median rate."""
    path = scratch(spark)
    f = frames_of(spark, d).where("original_frame_id is not null and pts_sec is not null").select("video_id", F.col("keyframe_n").alias("n"), F.col("pts_sec").alias("pts_time"), (25 + F.col("keyframe_n") % 3).alias("fps"), F.col("original_frame_id").alias("frame_idx"))
    f.repartition("video_id").write.partitionBy("video_id").option("header", True).csv(path)
    return readers.keyframe_map(spark, path)


def _speech_files(spark, d):
    path = scratch(spark)
    e = F.to_json(F.struct(*[_lists(c).alias(k) for k, c in (("persons", "asr_persons"), ("orgs", "asr_orgs"), ("locations", "asr_locations"))]))
    s = speech_of(spark, d).select("segment", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.lit("").alias("text"), "speech_score", "video_id", "title", "author", "channel_id", "watch_url", "text_corrected", e.alias("entities"))
    s.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    return path


def speech_segments_csv(spark, d):
    """Enriched speech files as segments: at least two words, reversed times swapped."""
    r = readers.speech_csv(spark, _speech_files(spark, d))
    return r.select("video_id", "segment", "start_sec", "end_sec", F.length("text_corrected").alias("characters"), F.concat_ws("|", "asr_persons").alias("persons"), "author")


def speech_spans_csv(spark, d):
    """Enriched speech files for pooling: any text, an end before the start is the start."""
    r = readers.speech_spans(spark, _speech_files(spark, d))
    return r.groupBy("video_id").agg(F.count("*").alias("spans"), F.round(F.sum("end_sec") - F.sum("start_sec"), 3).alias("seconds"), F.sum(F.size("entities")).alias("names"))


def caption_spans_json(spark, d):
    """Caption files, one a video, with ends by the next start."""
    path = scratch(spark)
    t = etl.pick_transcript(once_per_key(table(spark, d, "transcripts"), ["transcript_id"], "fetched_at")).where("segments is not null")
    t.select("video_id", F.to_json("segments").alias("value")).repartition("video_id").write.partitionBy("video_id").text(path)
    return readers.caption_spans(spark, path).groupBy("video_id").agg(F.count("*").alias("captions"), F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 3).alias("seconds"))


def shot_list_json(spark, d):
    """Shot lists, one JSON file a video, numbered by start."""
    path = scratch(spark)
    listed = shots_of(spark, d).groupBy("video_id").agg(F.to_json(F.collect_list(F.array("start_frame", "end_frame"))).alias("value"))
    listed.repartition("video_id").write.partitionBy("video_id").text(path)
    return readers.shot_lists(spark, path)


def shot_list_csv(spark, d):
    """One CSV of shots with their own ids."""
    path = scratch(spark)
    shots_of(spark, d).select("video_id", "shot_id", "start_frame", "end_frame").write.option("header", True).csv(path)
    return readers.shot_csv(spark, path)


def ocr_lines_json(spark, d):
    """Recognised regions as JSON lines with parallel arrays."""
    path = scratch(spark)
    f = frames_of(spark, d, "ocr_text").where("ocr_text is not null").select("video_id", "keyframe_n", F.split("ocr_text", " · ").alias("texts"))
    f.withColumn("scores", F.transform("texts", lambda t: F.lit(0.5))).write.json(path)
    return readers.ocr_lines(spark, path).groupBy("video_id", "keyframe_n").agg(F.count("*").alias("regions"), F.sum(F.length("text")).alias("characters"))


def caption_csv_utf16(spark, d):
    """Captions in UTF-16, one CSV a video."""
    path = scratch(spark)
    f = frames_of(spark, d, "caption_vi").where("trim(caption_vi) <> ''").select("video_id", F.format_string("%03d.jpg", "keyframe_n").alias("keyframe"), F.trim("caption_vi").alias("response"))
    f.repartition("video_id").write.partitionBy("video_id").option("header", True).option("escape", '"').option("encoding", "UTF-16").csv(path)
    return readers.caption_csv(spark, path)


def enrichment_json(spark, d):
    """Enrichment lines of which the last of a key counts: every frame once with nothing to say and once with its texts."""
    path = scratch(spark)
    f = frames_of(spark, d, "ocr_text", "caption_vi").select("video_id", "keyframe_n", "ocr_text", F.col("caption_vi").alias("caption"))
    old = f.withColumn("ocr_text", F.lit("old")).withColumn("caption", F.lit("old"))
    old.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([('{"video_id": "L01_V0',), ("",)], "value string")).coalesce(1).write.text(f"{path}/a")
    f.where("coalesce(ocr_text, caption) is not null").select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{path}/b")
    return readers.enrichment_lines(spark, f"{path}/*")


def media_info_ids(spark, d):
    """The ids in the watch addresses of media-info texts."""
    s = table(spark, d, "asr_segments").select("video_id", "title", "watch_url").distinct()
    text = F.to_json(F.struct("title", "watch_url"))
    return s.select("video_id", readers.media_info_id(text).alias("youtube_id"), readers.media_info(text)["title"].alias("title")).distinct()


def object_counts(spark, d):
    """How often each object is in a keyframe's detections before the first weak one."""
    f = frames_of(spark, d, "objects").where("size(objects) > 0")
    scores = F.transform("objects", lambda x, i: 0.9 - 0.25 * i)
    m = etl.detections(F.col("objects"), scores, 0.3)
    return f.select("video_id", "keyframe_n", F.explode(m).alias("object", "n"))


def collection_versions(spark, d):
    """A collection created, changed by key twice alike, compacted, copied with checksums and restored."""
    c, path = writers.Collection(spark, scratch(spark)), scratch(spark)
    v = once_per_key(table(spark, d, "videos"), ["video_id"], None).select("video_id", "codec", "width")
    c.create(v)
    new = v.where("codec is not null").withColumn("codec", F.lower("codec"))
    c.upsert(new, ["video_id"])
    c.upsert(new, ["video_id"])
    c.compact(2)
    c.snapshot(path, "1.9.2")
    c.upsert(v.withColumn("codec", F.lit("lost")), ["video_id"])
    c.restore(path, "1.9.3")
    return c.current()


def submission_json(spark, d):
    """Of every video the first keyframes as one JSON submission of a sequence."""
    f = frames_of(spark, d).where("original_frame_id is not null").groupBy("video_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("keyframe_n", "original_frame_id"))), 1, 4).alias("k"))
    rows = f.select(F.row_number().over(W.orderBy("video_id")).alias("position"), "video_id", F.col("k.original_frame_id").alias("frame_ids")).where("position <= 100")
    return submit.as_json(rows, "trake")


def detected_shots(spark, d):
    """Clip rows from a score per keyframe, with times by the video's rate, short shots merged."""
    from reelgrid.plans.etl_queries import _series

    v = once_per_key(table(spark, d, "videos"), ["video_id"], None).select("video_id", "fps_num", "fps_den", "path")
    return shots.detect_shots(_series(spark, d), v, "transition", shortest=3).select("video_id", "shot_id", "start_frame", "end_frame", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "path")


def answer_lines(spark, d):
    """Numbered lines and sections of answers made of every keyframe's texts."""
    f = frames_of(spark, d, "ocr_text", "caption_vi").where("ocr_text is not null and caption_vi is not null")
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    numbered = numbered_lines(F.concat(F.lit("<think>1. x</think>\n2) "), F.trim(flat("caption_vi")), F.lit("\n1. một\nxong")))
    s = picture_sections(F.concat(F.lit("x\nCHỮ:\n"), flat("ocr_text"), F.lit("\nMô tả\n"), flat("caption_vi")))
    return f.select("video_id", "keyframe_n", F.size(F.coalesce(numbered, F.array().cast("array<string>"))).alias("lines"), s["text"].alias("text"), s["caption"].alias("caption"))


QUERIES = {f.__name__: f for f in (manifest_rows, manifest_count, pending_videos, keyframe_map_csv, speech_segments_csv, speech_spans_csv, caption_spans_json, shot_list_json, shot_list_csv, ocr_lines_json, caption_csv_utf16, enrichment_json, media_info_ids, object_counts, collection_versions, submission_json, detected_shots, answer_lines)}


def _w(*parts: str) -> str:
    return "with " + ",\n".join(parts) + " "


_V = "v as (select distinct video_id, codec, width, path, fps_num, fps_den from videos)"
_EMPTY = "('', 'nan', 'none', 'null')"
_STRIP = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
_FLAT = "regexp_replace({t}, '\\s+', ' ', 'g')"
SQL = {
    "manifest_rows": _w(CLIPS) + "select " + ", ".join(ENTITIES["clip"].names) + " from c",
    "manifest_count": "select count(*) as rows from (select distinct * from videos)",
    "pending_videos": _w(CLIPS) + "select distinct video_id from videos where video_id not in (select video_id from c)",
    "keyframe_map_csv": _w(FRAMES) + ", k as (select video_id, keyframe_n, original_frame_id, pts_sec, 25 + keyframe_n % 3 as r from f where original_frame_id is not null and pts_sec is not null) select video_id, keyframe_n, original_frame_id, pts_sec, median(r) over (partition by video_id) as fps from k",
    "speech_segments_csv": _w(SPEECH) + f""", k as (select video_id, segment, coalesce(start_sec, 0) as a, coalesce(end_sec, 0) as b, trim(text_corrected, ' ') as t, asr_persons, author from s)
select video_id, segment, least(a, b) as start_sec, greatest(a, b) as end_sec, length(t) as characters,
  coalesce(array_to_string(list_filter(list_transform(asr_persons, lambda x: trim(x)), lambda x, i: lower(x) not in {_EMPTY} and list_position(list_transform(asr_persons, lambda y: trim(y)), x) = i), '|'), '') as persons, case when author is null or lower(trim(author)) in {_EMPTY} then '' else trim(author) end as author
from k where t is not null and lower(t) not in {_EMPTY} and len(string_split(trim({_FLAT.format(t='t')}, ' '), ' ')) >= 2""",
    "speech_spans_csv": _w(SPEECH) + """, k as (select *, trim(text_corrected) as t, list_concat(list_concat(coalesce(asr_persons, []), coalesce(asr_orgs, [])), coalesce(asr_locations, [])) as l from s where start_sec is not null and end_sec is not null)
select video_id, count(*) as spans, round(sum(greatest(start_sec, end_sec)) - sum(start_sec), 3) as seconds, cast(sum(len(list_filter(l, lambda x: trim(x) <> ''))) as bigint) as names from k where t <> '' and t <> 'nan' group by all""",
    "caption_spans_json": """with t as (select distinct video_id, transcript_id, is_generated, segments from transcripts), p as (select * from (select *, row_number() over (partition by video_id order by case when not is_generated then 0 when is_generated then 1 else 2 end, transcript_id) as r from t) where r = 1),
e as (select video_id, unnest(segments) as g from p where segments is not null), k as (select video_id, g.start as a, coalesce(g.duration, 0) as dur, g.text as x from e where g.start is not null and trim(g.text) <> ''),
n as (select *, lead(a) over (partition by video_id order by a, x) as nx from k) select video_id, count(*) as captions, round(sum(greatest(coalesce(nx, a + dur), a) - a), 3) as seconds from n group by all""",
    "shot_list_json": _w(CLIPS) + "select video_id, cast(row_number() over (partition by video_id order by start_frame, end_frame) - 1 as int) as shot_id, start_frame, end_frame from c",
    "shot_list_csv": _w(CLIPS) + "select video_id, shot_id, start_frame, end_frame from c",
    "ocr_lines_json": _w(FRAMES) + ", e as (select video_id, keyframe_n, unnest(string_split(ocr_text, ' · ')) as t from f where ocr_text is not null) select video_id, keyframe_n, count(*) as regions, cast(sum(length(t)) as bigint) as characters from e group by all",
    "caption_csv_utf16": _w(FRAMES) + f"select video_id, keyframe_n, {_STRIP.format(t='caption_vi')} as caption from f where trim(caption_vi) <> ''",
    "enrichment_json": _w(FRAMES) + "select video_id, keyframe_n, case when coalesce(ocr_text, '') <> '' or coalesce(caption_vi, '') <> '' then ocr_text else 'old' end as ocr_text, case when coalesce(ocr_text, '') <> '' or coalesce(caption_vi, '') <> '' then caption_vi else 'old' end as caption from f",
    "media_info_ids": "select distinct video_id, coalesce(nullif(regexp_extract(watch_url, '(?:v=|youtu\\.be/|/embed/|/shorts/|/vi/)([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(title, '(?:v=|youtu\\.be/|/embed/|/shorts/|/vi/)([A-Za-z0-9_-]{11})', 1), '')) as youtube_id, title from asr_segments",
    "object_counts": _w(FRAMES) + ", e as (select video_id, keyframe_n, unnest(objects[1:3]) as object from f where len(objects) > 0) select video_id, keyframe_n, object, cast(count(*) as int) as n from e group by all",
    "collection_versions": _w(_V) + "select video_id, lower(codec) as codec, width from v",
    "submission_json": _w(FRAMES) + """, k as (select video_id, list(original_frame_id order by keyframe_n)[1:4] as l from f where original_frame_id is not null group by all), p as (select *, row_number() over (order by video_id) as r from k)
select '[' || string_agg('{"task":"trake","fields":["' || video_id || '"' || array_to_string(list_transform(l, lambda x: ',"' || x || '"'), '') || ']}', ',' order by r) || ']' as submission from p where r <= 100""",
    "answer_lines": _w(FRAMES) + f""", k as (select video_id, keyframe_n, trim({_FLAT.format(t='ocr_text')}, ' ') as o, trim({_FLAT.format(t='caption_vi')}, ' ') as c from f where ocr_text is not null and caption_vi is not null)
select video_id, keyframe_n, case when c = '' then 0 else 2 end as lines, case when upper(o) like 'KHÔNG%' then '' else o end as text, c as caption from k""",
}


def _merged() -> str:
    from reelgrid.plans.etl_queries import SQL as etl_sql

    s = etl_sql["merge_short_scenes"]
    head, tail = s[: s.rindex("select video_id, min(a) as start_frame")], s[s.rindex("select video_id, min(a) as start_frame") :]
    return f"{head.rstrip()}, z as ({tail}), v as (select distinct video_id, path, fps_num, fps_den from videos) select z.video_id, row_number() over (partition by z.video_id order by start_frame) - 1 as shot_id, start_frame, end_frame, round(start_frame * fps_den / fps_num, 6) as start_sec, round(end_frame * fps_den / fps_num, 6) as end_sec, path from z join v using (video_id)"


SQL["detected_shots"] = _merged()
