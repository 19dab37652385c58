"""The entry points over the test tables: whole result rows, flattened to text so that SQL can be held against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import per_video, sequence
from reelgrid.plans import entry
from reelgrid.plans.search_queries import BONUS, DIM, EVENTS, FRAMES, FUSED_SPEECH, HF, OCR_DOCS, POINTS, QUERY_WORDS, SPEECH, SPEECH_DOCS, SQL as SEARCH, _dedupe_sql, _event_queries, _hits_sql, _pooled_shots, _queries, _sparse_sql, _video_points, _with, frames_of, index_of, speech_of
from reelgrid.plans.search_queries import frame_key
from reelgrid.session import kept, table

CONFIG = entry.RetrievalConfig(dim=DIM)


def _corpus(spark, d) -> entry.Corpus:
    places = frames_of(spark, d, "ocr_text").select("video_id", "keyframe_n", "shot_id", F.col("original_frame_id").alias("frame_id"), "pts_sec", "low", "high", "ocr_text", F.col("key").alias("id"))
    points = _video_points(spark, d, False).select("point_id", "v", "id")
    frames = kept(points.join(places, "id"))
    segments = speech_of(spark, d).select(frame_key(n="segment").alias("id"), "video_id", "segment", "start_sec", "end_sec", F.col("text_corrected").alias("text"))
    return entry.Corpus(frames, _pooled_shots(spark, d), kept(segments), index_of(spark, d, "ocr_text"), index_of(spark, d, "speech"))


def _screen_corpus(spark, d) -> entry.Corpus:
    """What the search by words on screen reads: frames that have a point, without its vector; no shots and no speech."""
    finite = ~F.exists("dense_video", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("dense_video", lambda x: x != 0)
    p = table(spark, d, "frame_vectors").where((F.size("dense_video") == DIM) & finite)
    # The vector is looked at before points are counted once, so none is shuffled.
    p = p.groupBy("point_id").agg(F.min_by(F.struct("video_id", "keyframe_n"), "ingested_at").alias("r")).select("r.*").distinct()
    f = frames_of(spark, d, "ocr_text").select("video_id", "keyframe_n", "shot_id", F.col("original_frame_id").alias("frame_id"), "ocr_text", F.col("key").alias("id"))
    frames = f.where("id is not null").join(p, ["video_id", "keyframe_n"], "left_semi")
    return entry.Corpus(kept(frames), screen_index=index_of(spark, d, "ocr_text"))


def _texts(spark, d):
    """Every query point with its vector and the words of its caption."""
    p = table(spark, d, "frame_vectors").select(F.col("point_id").alias("query_id"), "video_id", "keyframe_n").distinct().join(_queries(spark, d), "query_id")
    f = frames_of(spark, d, "caption_vi", only=p.select("video_id", "keyframe_n")).select("video_id", "keyframe_n", F.col("caption_vi").alias("text"))
    return kept(p.join(f, ["video_id", "keyframe_n"], "left").select("query_id", "v", "text", F.col("text").alias("speech")))


def _flat(rows):
    listed = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return rows.select("query_id", "rank", "video_id", listed("frame_ids").alias("frames"), F.round("score", 6).alias("score"))


def search_ocr_rows(spark, d):
    """Search by the words on screen, as result rows."""
    r = entry.search_ocr(_texts(spark, d), _screen_corpus(spark, d), CONFIG, 10)
    return r.select("query_id", "rank", "video_id", F.element_at("frame_ids", 1).alias("frame_id"), F.round("score", 6).alias("score"), "ocr_text")


def search_speech_rows(spark, d):
    """Search by speech alone, as result rows with their evidence."""
    r = entry.search_frames(_texts(spark, d), _corpus(spark, d), CONFIG.resolved(asr_dense_weight=0.0, asr_sparse_weight=1.0, asr_top_k=50), 20, "asr_only")
    return r.select("query_id", "rank", "video_id", F.element_at("frame_ids", 1).alias("frame_id"), F.round("score", 6).alias("score"), F.col("asr_evidence.segment").alias("segment"))


def search_kis_rows(spark, d):
    """Known-item search by pictures alone: frames and whole shots fused, one hit per shot."""
    r = entry.search_kis(_texts(spark, d), _corpus(spark, d), CONFIG, 10, "visual")
    return _flat(r)


def search_trake_rows(spark, d):
    """Event search: sequences with stage A's scores, each event's frame and the number of those it beat."""
    q = _event_queries(spark, d)
    over = q.where("event = 0").select("query_id", F.lit(per_video.OVERVIEW).alias("event"), F.lit(None).cast("bigint").alias("point_id"), "v")
    r = entry.search_trake(q.unionByName(over), _corpus(spark, d), CONFIG, 3, 20)
    counts = F.concat_ws(",", F.transform("events", lambda e: F.size(e["alternates"]).cast("string")))
    return _flat(r).join(r.select("query_id", "video_id", F.col("stage_a.rank").alias("video_rank"), F.round("stage_a.overview_score", 6).alias("overview_score"), counts.alias("alternates")), ["query_id", "video_id"])


def _two_events(spark, d):
    """The hits of the first two events of each query among the candidates of the event search."""
    from reelgrid.plans.search_queries import topn_per_video

    f = frames_of(spark, d).select(F.col("key").alias("id"), "pts_sec")
    return kept(topn_per_video(spark, d).join(f, "id").drop("place"))


def pair_scores(spark, d):
    """Two events in a row: ten times the best ordered pair and five times both means."""
    return sequence.pair_scores(_two_events(spark, d).where("event < 2")).withColumn("score", F.round("score", 9))


def three_part_scores(spark, d):
    """The middle event's hits with what the events before and after reach in the same video."""
    h = _two_events(spark, d)
    part = lambda e: h.where(F.col("event") == e)
    return sequence.rescored_by_neighbours(part(1), part(0), part(2)).select("query_id", "video_id", "frame_id", "id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (search_ocr_rows, search_speech_rows, search_kis_rows, search_trake_rows, pair_scores, three_part_scores)}

_TRAKE = SEARCH["trake_search"][: SEARCH["trake_search"].rindex(" select bs.query_id")]
_SLOTS = SEARCH["topn_per_video"][: SEARCH["topn_per_video"].rindex(" select query_id, event")]
# Only query points whose vector can be compared ask.
_ASKED = QUERY_WORDS.replace("where f.caption_vi is not null", "where f.caption_vi is not null and m.point_id in (select id from p)")
_FUSED = FUSED_SPEECH.replace("0.7 * score", "1.0 * score").replace(" union all select * exclude (score), 0.3 * score from sc", "")
_NEAR = SEARCH["asr_only"][SEARCH["asr_only"].index("nf as (") : SEARCH["asr_only"].rindex(" select * from (select *, row_number()")].replace("round(fs.score, 6) as score", "fs.score").replace("from fs join f on", "from fs join fp f on")
_ALTERNATES = SEARCH["trake_alternates"][SEARCH["trake_alternates"].index("pq as (select query_id, video_id, 0") : SEARCH["trake_alternates"].rindex(" select query_id, video_id, event, place")]
SQL = {
    "search_ocr_rows": _with(POINTS, FRAMES, _ASKED, _sparse_sql("oh", OCR_DOCS, 50)) + f", of as (select oh.*, f.video_id, coalesce(f.shot_id, 0) as shot_id, f.original_frame_id, f.ocr_text from oh join f on oh.id = f.key where f.key in (select p.id2 from (select f2.key as id2 from p join f f2 on p.video_id = f2.video_id and p.keyframe_n = f2.keyframe_n) p)), dd as ({_dedupe_sql('of', 'video_id, shot_id', 10)}) select dd.query_id, dd.rank, dd.video_id, coalesce(of.original_frame_id, 0) as frame_id, dd.score, of.ocr_text from dd join of on of.query_id = dd.query_id and of.id = dd.id",
    "search_kis_rows": _with(POINTS, FRAMES, _hits_sql(50).replace("q.id <> p.id", "true"), HF) + ", " + SEARCH["frame_clip_fusion"][SEARCH["frame_clip_fusion"].index("pv as (") : SEARCH["frame_clip_fusion"].index("cb as (")].replace("rank <= 30", "rank <= 50").replace("fb as (select query_id, video_id, shot_id, frame_id, score as f", "fb as (select query_id, video_id, shot_id, frame_id, id, score as f") + """
cb as (select query_id, video_id, shot_id, id as cid, score as c from (select *, row_number() over (partition by query_id, video_id, shot_id order by score desc, id) as rn from ch) where rn = 1), cm as (select query_id, min(c) as cm from cb group by all), fm as (select query_id, min(f) as fm from fb group by all),
fu as (select query_id, video_id, shot_id, coalesce(fb.id, cid) as id, coalesce(fb.frame_id, 0) as frame_id, coalesce(f, fm, 0) + 0.5 * coalesce(c, cm) as score from fb full join cb using (query_id, video_id, shot_id) left join fm using (query_id) left join cm using (query_id))
select query_id, rank, video_id, cast(frame_id as varchar) as frames, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, video_id, shot_id, id) as rank from fu) where rank <= 10""",
    "search_trake_rows": f"""{_TRAKE}, {_ALTERNATES}, an as (select query_id, video_id, event, least(count(distinct frame_id || ':' || score), 5) as n, count(*) as m from al group by all),
rk as (select query_id, video_id, row_number() over (partition by query_id order by round(score, 9) desc, video_id) as rank from bs)
select bs.query_id, rk.rank, bs.video_id, concat_ws(',', f0, f1, f2) as frames, round(bs.score, 6) as score, sa.rank as video_rank, round(sa.o, 6) as overview_score,
  concat_ws(',', least(coalesce(a.m, 0), 5), least(coalesce(b.m, 0), 5), least(coalesce(c.m, 0), 5)) as alternates from bs join rk using (query_id, video_id) join sa on sa.query_id = bs.query_id and sa.video_id = bs.video_id
  left join an a on a.query_id = bs.query_id and a.video_id = bs.video_id and a.event = 0 left join an b on b.query_id = bs.query_id and b.video_id = bs.video_id and b.event = 1 left join an c on c.query_id = bs.query_id and c.video_id = bs.video_id and c.event = 2 where rk.rank <= 20""",
    "pair_scores": f"""{_SLOTS}, t as (select sv.query_id, sv.video_id, sv.event, sv.score, sv.pts_sec as pts from sv where event < 2 and place <= 10), m as (select query_id, video_id, coalesce(avg(score) filter (event = 0), 0) + coalesce(avg(score) filter (event = 1), 0) as m from t group by all),
p2 as (select a.query_id, a.video_id, max(a.score + b.score) as pair from t a join t b on a.query_id = b.query_id and a.video_id = b.video_id and a.event = 0 and b.event = 1 and b.pts - a.pts > 0 and b.pts - a.pts <= 300 group by all)
select query_id, video_id, round(10 * coalesce(pair, 0) + 5 * m, 9) as score from m left join p2 using (query_id, video_id)""",
    "three_part_scores": f"""{_SLOTS}, b as (select query_id, video_id, event, max(score) as s from sv group by all)
select sv.query_id, sv.video_id, sv.frame_id, sv.id, round(sv.score + coalesce(a.s, 0) + coalesce(c.s, 0), 6) as score from sv left join b a on a.query_id = sv.query_id and a.video_id = sv.video_id and a.event = 0 left join b c on c.query_id = sv.query_id and c.video_id = sv.video_id and c.event = 2 where sv.event = 1""",
    # Only frames that have a point are searched.
    "search_speech_rows": _with(POINTS, FRAMES, SPEECH, _ASKED, _FUSED) + ", fp as (select f.* from f semi join p on p.video_id = f.video_id and p.keyframe_n = f.keyframe_n), " + _NEAR + " select query_id, rank, video_id, frame_id, round(score, 6) as score, segment from (select *, row_number() over (partition by query_id order by score desc, video_id, segment, frame_id) as rank from nb) where rank <= 20",
}
