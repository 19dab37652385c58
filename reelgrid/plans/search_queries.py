"""Search, fusion, ranking and sequence queries.

The query vectors are the points whose id is divisible by 100; the words of such a query are the
caption of its keyframe. Three such points in a row make an event query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions.scalar import time_window
from reelgrid.operators import etl, per_video, ranking, search, sequence, temporal
from reelgrid.operators.lexical import LexicalIndex, query_terms
from reelgrid.session import kept, once_per_key, table

DIM = 96
EVERY = 100
#: Indexes of this process by application, data and name.
_INDEXES: dict[tuple[str, str, str], LexicalIndex] = {}


def frame_key(video: str = "video_id", n: str = "keyframe_n") -> Column:
    """A number for (video_id, keyframe_n): L12_V034 and 5 give 1203400005."""
    return (F.substring(video, 2, 2).try_cast("bigint") * 1000 + F.substring(video, 6, 3).try_cast("bigint")) * 100_000 + F.col(n)


FRAME_COLUMNS = ("shot_id", "original_frame_id", "pts_sec", "shot_start_sec", "shot_end_sec")


def frames_of(spark: SparkSession, d: str, *more: str, only: DataFrame | None = None) -> DataFrame:
    """Every keyframe once, with its key and window; only the columns asked for are read.

    ``only`` (any of video_id, keyframe_n and key) leaves the others out before their repeats are looked for.
    """
    rows = table(spark, d, "frames").select("video_id", "keyframe_n", *FRAME_COLUMNS, *more, "ingested_at")
    if only is not None:
        rows = rows.withColumn("key", frame_key()).join(only, only.columns, "left_semi").drop("key")
    f = once_per_key(rows, ["video_id", "keyframe_n"])
    w = time_window(F.col("shot_start_sec"), F.col("shot_end_sec"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("pts_sec"))
    return f.withColumn("key", frame_key()).withColumn("w", w).withColumn("low", F.col("w.low")).withColumn("high", F.col("w.high")).drop("w")


def points_of(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """Points with a vector of the right length; repeated rows stay in unless ``once``.

    What else makes a vector unusable the operators over vectors leave out themselves.
    """
    p = table(spark, d, "frame_vectors").where(F.size("dense_video") == DIM)
    if once:
        # Repeats repeat the whole row, so the first of each point will do; nothing is ordered by its vector.
        p = p.groupBy("point_id").agg(F.min_by(F.struct("video_id", "keyframe_n", "dense_video"), "ingested_at").alias("r")).select("point_id", "r.*")
    return p.select(F.col("point_id").alias("id"), "video_id", "keyframe_n", F.col("dense_video").alias("v"))


def usable_points(spark: SparkSession, d: str) -> DataFrame:
    """Every point once whose vector can be compared."""
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return points_of(spark, d).where(finite)


def speech_of(spark: SparkSession, d: str) -> DataFrame:
    return once_per_key(table(spark, d, "asr_segments"), ["video_id", "segment"])


def shots_of(spark: SparkSession, d: str) -> DataFrame:
    return once_per_key(table(spark, d, "clips"), ["video_id", "shot_id"]).where("start_frame is not null and end_frame >= start_frame")


def dense_hits(spark: SparkSession, d: str, k: int, keep: str = "true") -> DataFrame:
    """(query_id, id, score, rank) of the query points against all points that pass ``keep``."""
    p = points_of(spark, d, once=False)  # the search itself counts each id once
    return search.knn(p.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "v"), p.where(keep).select("id", "v"), k, DIM)


def with_frames(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """Hits with what their keyframe knows; the id becomes the frame's key.

    The hits are written first: they are few, so they are broadcast to the points and frames, of which
    only those that were hit are looked at.
    """
    hits = kept(hits)
    places = table(spark, d, "frame_vectors").select(F.col("point_id").alias("id"), "video_id", "keyframe_n")
    meta = kept(places.join(hits.select("id").distinct(), "id", "left_semi").distinct())
    f = frames_of(spark, d, "ocr_text", only=meta.select("video_id", "keyframe_n")).select("video_id", "keyframe_n", "shot_id", F.col("original_frame_id").alias("frame_id"), "pts_sec", "low", "high", "ocr_text")
    h = hits.join(meta, "id").join(f, ["video_id", "keyframe_n"], "left").withColumn("shot_id", F.coalesce("shot_id", F.lit(0)))
    return h.withColumn("id", frame_key())


def _pooled_shots(spark: SparkSession, d: str) -> DataFrame:
    """(id, video_id, shot_id, v): the mean of each shot's unit vectors, named by its smallest point."""
    f = frames_of(spark, d).select("video_id", "keyframe_n", "shot_id")
    v = kept(usable_points(spark, d).join(f, ["video_id", "keyframe_n"]).select("id", "video_id", F.coalesce("shot_id", F.lit(0)).alias("shot_id"), "v"))
    pooled = etl.mean_pool(v, ["video_id", "shot_id"], "v").where("v is not null").withColumn("v", F.col("v").cast("array<float>"))
    return kept(pooled.join(v.groupBy("video_id", "shot_id").agg(F.min("id").alias("id")), ["video_id", "shot_id"]))


def clip_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Hits of whole shots: the query against the mean of the shot's vectors."""
    keyed = _pooled_shots(spark, d)
    q = points_of(spark, d, once=False).where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "v")
    hits = kept(search.knn(q, keyed.select("id", "v"), k, DIM, exclude_self=False))
    return hits.join(keyed.select("id", "video_id", "shot_id"), "id")


def query_words(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, token, weight) of the captions of the query points."""
    p = kept(table(spark, d, "frame_vectors").where(F.col("point_id") % EVERY == 0).select(F.col("point_id").alias("query_id"), "video_id", "keyframe_n").distinct())
    f = frames_of(spark, d, "caption_vi", only=p.select("video_id", "keyframe_n")).select("video_id", "keyframe_n", F.col("caption_vi").alias("t"))
    return query_terms(p.join(f, ["video_id", "keyframe_n"]))


def speech_docs(spark: SparkSession, d: str) -> DataFrame:
    return speech_of(spark, d).where("text_corrected is not null").select(frame_key(n="segment").alias("id"), F.col("text_corrected").alias("t"))


def screen_docs(spark: SparkSession, d: str, column: str = "ocr_text") -> DataFrame:
    return frames_of(spark, d, column).where(F.col(column).isNotNull()).select(F.col("key").alias("id"), F.col(column).alias("t"))


_DOCS = {"speech": speech_docs, "ocr_text": screen_docs, "caption_vi": lambda spark, d: screen_docs(spark, d, "caption_vi")}


def index_of(spark: SparkSession, d: str, name: str) -> LexicalIndex:
    """The index over one kind of text, built when it is first asked for and used by all searches of the application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        _INDEXES[key] = LexicalIndex(_DOCS[name](spark, d))
    return _INDEXES[key]


def sparse_hits(spark: SparkSession, d: str, name: str, k: int) -> DataFrame:
    """(query_id, id, score, rank): the words of the query points against one kind of text."""
    return index_of(spark, d, name).search(query_words(spark, d), k)


def speech_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Segments found by words, written once: query_id, video_id, segment, start_sec, end_sec, score, speech_score."""
    h = kept(sparse_hits(spark, d, "speech", k))
    s = table(spark, d, "asr_segments").select("video_id", "segment", "start_sec", "end_sec", "speech_score", "ingested_at").withColumn("id", frame_key(n="segment")).join(h.select("id").distinct(), "id", "left_semi")
    return kept(h.join(once_per_key(s, ["video_id", "segment"]).drop("ingested_at"), "id"))


def _hit_columns(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "video_id", "shot_id", "id", F.round("score", 6).alias("score"))


def _with_shots(spark: SparkSession, d: str, hits: DataFrame, *more: str) -> DataFrame:
    """Hits whose id is a frame's key, with the frame's video and shot."""
    hits = kept(hits)
    f = frames_of(spark, d, *more, only=hits.select(F.col("id").alias("key")).distinct()).select(F.col("key").alias("id"), "video_id", F.coalesce("shot_id", F.lit(0)).alias("shot_id"), F.col("original_frame_id").alias("frame_id"), *more)
    return hits.join(f, "id")


def screen_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return _with_shots(spark, d, sparse_hits(spark, d, "ocr_text", k), "ocr_text")


def knn_topk(spark, d):
    return dense_hits(spark, d, 10)


def knn_filtered(spark, d):
    return dense_hits(spark, d, 5, "video_id in ('L01_V001', 'L02_V001', 'L03_V002')")


def dedupe_shot(spark, d):
    return _hit_columns(ranking.dedupe_by_shot(with_frames(spark, d, dense_hits(spark, d, 50)), 10))


def dedupe_video(spark, d):
    return _hit_columns(ranking.dedupe_by_video(with_frames(spark, d, dense_hits(spark, d, 50)), 10))


def video_max_score(spark, d):
    """The 1,000 best videos of each query by their best point, of all points."""
    q = _queries(spark, d).select("query_id", F.lit(0).alias("event"), F.col("query_id").alias("point_id"), "v")
    return per_video.videos_by_score(q, _video_points(spark, d, False), 1000, 1).select("query_id", "video_id", "score")


def kis_visual(spark, d, k: int = 20):
    """Over-fetch, one hit per shot, ranks, cut."""
    return _hit_columns(ranking.dedupe_by_shot(with_frames(spark, d, dense_hits(spark, d, search.overfetch_limit(k))), k))


def overfetch_dedupe(spark, d):
    return kis_visual(spark, d, 4)


def minmax_normalize(spark, d):
    return ranking.normalize(dense_hits(spark, d, 20)).select("query_id", "id", F.round("score", 6).alias("score"))


def frame_clip_fusion(spark, d):
    clips = clip_hits(spark, d, 30).withColumn("frame_id", F.lit(None).cast("bigint"))
    fused = ranking.fuse_frames_and_clips(with_frames(spark, d, dense_hits(spark, d, 50)).select(*ranking.SHOT, "id", "frame_id", "score"), clips.select(*ranking.SHOT, "id", "frame_id", "score"))
    return fused.select("query_id", "video_id", "shot_id", "frame_id", (F.round(F.col("score") * 1e7) / 1e7).alias("score"))


def rrf_two_list(spark, d):
    fused = ranking.rrf_two(with_frames(spark, d, dense_hits(spark, d, 50)), screen_hits(spark, d, 50))
    return fused.select("query_id", "video_id", "shot_id", "frame_id", "ocr_text", F.round("score", 8).alias("score"))


def _hybrid(spark, d, k: int):
    dense = with_frames(spark, d, dense_hits(spark, d, k)).select("query_id", "id", "rank")
    return ranking.rrf_many([dense, sparse_hits(spark, d, "ocr_text", k), sparse_hits(spark, d, "caption_vi", k)])


def rrf_multi_list(spark, d):
    return _hybrid(spark, d, 50).select("query_id", "id", F.round("score", 8).alias("score"))


def hybrid_search(spark, d):
    """Server-side fusion of three lists, then one hit per shot."""
    fused = _with_shots(spark, d, _hybrid(spark, d, 50).withColumn("score", F.round("score", 8)))
    return ranking.dedupe_by_shot(fused, 20).select("query_id", "rank", "video_id", "shot_id", "id", "score")


def token_tf(spark, d):
    return index_of(spark, d, "ocr_text").postings.select("id", "token", "weight")


def token_df(spark, d):
    return index_of(spark, d, "ocr_text").idf.select("token", "df", F.round("idf", 6).alias("idf"))


def idf_sparse_topk(spark, d):
    return sparse_hits(spark, d, "ocr_text", 10)


def ocr_search(spark, d):
    return _hit_columns(ranking.dedupe_by_shot(screen_hits(spark, d, 50), 10))


def _fused_speech(spark, d, k: int = 50):
    """0.7 x words + 0.3 x recognition score of the segments found by words; written once."""
    s = speech_hits(spark, d, k)
    scored = s.where("speech_score is not null").withColumn("score", F.col("speech_score"))
    keys = ["query_id", "video_id", "segment"]
    return kept(ranking.weighted_fusion([(s, 0.7), (scored, 0.3)], keys).join(s.select(*keys, "start_sec", "end_sec"), keys))


def asr_weighted_fusion(spark, d):
    return _fused_speech(spark, d).select("query_id", "video_id", "segment", F.round("score", 6).alias("score"))


def _boosted(spark, d, k: int):
    hits = with_frames(spark, d, dense_hits(spark, d, search.overfetch_limit(k)))
    return ranking.speech_bonus(hits, _fused_speech(spark, d), weight=0.3, pad=1.0)


def speech_overlap_bonus(spark, d):
    return _boosted(spark, d, 10).select("query_id", "id", F.round("score", 6).alias("score"))


def kis_visual_asr(spark, d):
    boosted = _boosted(spark, d, 10).withColumn("score", F.round("score", 6))
    return ranking.dedupe_by_shot(boosted, 10).select("query_id", "rank", "video_id", "shot_id", "id", "score")


def asr_nearest_frame(spark, d):
    speech = _fused_speech(spark, d)
    f = frames_of(spark, d, only=speech.select("video_id").distinct()).select("video_id", "shot_id", F.col("original_frame_id").alias("frame_id"), "pts_sec", "low", "high").withColumn("shot_id", F.coalesce("shot_id", F.lit(0)))
    s = speech.withColumn("score", F.round("score", 6)).where("end_sec >= start_sec")
    return temporal.segments_to_frames(s, f).select("query_id", "video_id", "shot_id", "segment", "frame_id", "score")


def asr_only(spark, d):
    """Speech alone: the best frames by the score of their segment."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "video_id", "segment", "frame_id")
    return asr_nearest_frame(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 20")


def rerank_head(spark, d):
    """The first 5 hits by a second opinion (their screen text's length), the others below as they were."""
    h = ranking.dedupe_by_shot(with_frames(spark, d, dense_hits(spark, d, 50)), 10)
    out = ranking.rerank_head(h, F.length(F.coalesce("ocr_text", F.lit(""))) / 1000 + 1 / (10 + F.col("rank")), top_n=5)
    return out.select("query_id", F.col("new_rank").alias("rank"), "block", "id", F.round("score", 6).alias("score"))


def _queries(spark, d):
    """(query_id, v) of the query points, once each."""
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    p = points_of(spark, d, once=False).where((F.col("id") % EVERY == 0) & finite)
    return kept(p.groupBy(F.col("id").alias("query_id")).agg(F.first("v").alias("v")))


def _event_queries(spark, d):
    """Three query points in a row are the events of one query; the first one's vector is also its overview."""
    p = _queries(spark, d)
    event = F.pmod(F.floor(F.col("query_id") / EVERY), F.lit(3)).cast("int")
    return p.select(F.floor(F.col("query_id") / (3 * EVERY)).alias("query_id"), event.alias("event"), F.col("query_id").alias("point_id"), "v")


def _video_points(spark, d, frame_known: bool = True):
    """Every point with its place in its video, for searches by video; written once."""
    f = frames_of(spark, d).select("video_id", "keyframe_n", F.coalesce("shot_id", F.lit(0)).alias("shot_id"), F.col("original_frame_id").alias("frame_id"), "pts_sec", F.col("key"))
    p = usable_points(spark, d).withColumnRenamed("id", "point_id").join(f, ["video_id", "keyframe_n"], "left")
    return kept((p.where("frame_id is not null") if frame_known else p).select("point_id", "video_id", "frame_id", "pts_sec", "shot_id", F.col("key").alias("id"), "v"))


def _stage_a(spark, d, q: DataFrame, points: DataFrame) -> DataFrame:
    """The 100 best videos of each event query, over all their points and shots; written once."""
    over = q.where("event = 0").select("query_id", F.lit(per_video.OVERVIEW).alias("event"), F.lit(None).cast("bigint").alias("point_id"), "v")
    return kept(per_video.videos_by_score(q.unionByName(over), points, 100, 3, _pooled_shots(spark, d).select("video_id", "v")))


def stage_a_videos(spark, d):
    a = _stage_a(spark, d, _event_queries(spark, d), _video_points(spark, d))
    parts = F.concat_ws(",", F.transform("event_scores", lambda x: F.format_string("%.6f", x)))
    return a.select("query_id", "video_id", F.round("score", 6).alias("score"), F.round("overview_score", 6).alias("overview_score"), parts.alias("event_scores"))


def topn_per_video(spark, d):
    """The 20 best points of each event inside each candidate video, each video searched by itself."""
    q, p = _event_queries(spark, d), _video_points(spark, d)
    return per_video.slots_of_videos(_stage_a(spark, d, q, p), q, p).select("query_id", "event", "video_id", "place", "frame_id", "id", "score")


def _frames_text() -> Column:
    return F.concat_ws(",", F.transform("picks", lambda x: x["frame_id"].cast("string")))


def trake_sequence(spark, d):
    """The best sequence of every candidate video that has one, with its frames."""
    q, p = _event_queries(spark, d), _video_points(spark, d)
    s = per_video.sequences_of_videos(_stage_a(spark, d, q, p), q, p, 3)
    return s.select("query_id", "video_id", F.round("score", 6).alias("score"), _frames_text().alias("frames"))


def trake_alternates(spark, d):
    q, p = _event_queries(spark, d), _video_points(spark, d)
    a = _stage_a(spark, d, q, p)
    s = kept(per_video.sequences_of_videos(a, q, p, 3))
    slots = per_video.slots_of_videos(s.select("query_id", "video_id"), q, p)
    return sequence.alternates(slots, s).select("query_id", "video_id", "event", "place", "frame_id", F.round("score", 6).alias("score"))


def trake_search(spark, d):
    """The whole event search: candidate videos, sequences inside them, ranks, picked frames."""
    q, p = _event_queries(spark, d), _video_points(spark, d)
    a = _stage_a(spark, d, q, p)
    s = per_video.sequences_of_videos(a, q, p, 3).join(a.select("query_id", "video_id", F.col("rank").alias("video_rank")), ["query_id", "video_id"])
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "video_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("query_id", "rank", "video_id", F.round("score", 6).alias("score"), "video_rank", _frames_text().alias("frames"))


def neighbours(spark, d):
    """The two keyframes before and after every keyframe of its video."""
    f = frames_of(spark, d).select("video_id", "keyframe_n", "shot_id", "original_frame_id").where("original_frame_id is not null")
    return sequence.neighbours(f, 2)


NAMES = [knn_topk, knn_filtered, dedupe_shot, dedupe_video, video_max_score, kis_visual, overfetch_dedupe, minmax_normalize, frame_clip_fusion, rrf_two_list, rrf_multi_list, hybrid_search, token_tf, token_df, idf_sparse_topk, ocr_search, asr_weighted_fusion, speech_overlap_bonus, kis_visual_asr, asr_nearest_frame, asr_only, rerank_head, stage_a_videos, topn_per_video, trake_sequence, trake_alternates, trake_search, neighbours]
QUERIES = {f.__name__: f for f in NAMES}

_KEY = "(cast(substr(video_id, 2, 2) as bigint) * 1000 + cast(substr(video_id, 6, 3) as bigint)) * 100000 + {n}"
FRAMES = f"""f as (select * exclude (rn), {_KEY.format(n='keyframe_n')} as key,
  case when shot_start_sec is not null and shot_end_sec > shot_start_sec then shot_start_sec else pts_sec end as low,
  case when shot_start_sec is not null and shot_end_sec > shot_start_sec then shot_end_sec else pts_sec end as high
  from (select *, row_number() over (partition by video_id, keyframe_n order by ingested_at, shot_id, original_frame_id) as rn from frames) where rn = 1)"""
POINTS = """p as (select point_id as id, video_id, keyframe_n, list_transform(dense_video, lambda x: cast(x as double)) as v
  from (select *, row_number() over (partition by point_id order by ingested_at) as rn from frame_vectors
    where len(dense_video) = 96 and len(list_filter(dense_video, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(dense_video, lambda x: x <> 0)) > 0) where rn = 1)"""
SPEECH = f"""s as (select * exclude (rn), {_KEY.format(n='segment')} as id from (select *, row_number() over (partition by video_id, segment order by ingested_at) as rn from asr_segments) where rn = 1)"""


def _hits_sql(k: int, keep: str = "true") -> str:
    return f"""h as (select query_id, id, score, rank from (select q.id as query_id, p.id, round(list_cosine_similarity(q.v, p.v), 6) as score,
  row_number() over (partition by q.id order by round(list_cosine_similarity(q.v, p.v), 6) desc, p.id) as rank
  from (select * from p where id % 100 = 0) q join (select * from p where {keep}) p on q.id <> p.id) where rank <= {k})"""


HIT_FRAMES = f"""hf as (select h.query_id, h.score, h.rank, m.video_id, m.keyframe_n, coalesce(f.shot_id, 0) as shot_id, f.original_frame_id as frame_id, f.pts_sec, f.low, f.high, f.ocr_text, {_KEY.format(n='keyframe_n').replace('video_id', 'm.video_id').replace('keyframe_n', 'm.keyframe_n')} as id
  from h join (select distinct point_id, video_id, keyframe_n from frame_vectors) m on h.id = m.point_id left join f on f.video_id = m.video_id and f.keyframe_n = m.keyframe_n)"""
CLIP_HITS = """pv as (select p.id, list_transform(p.v, lambda x: x / sqrt(list_inner_product(p.v, p.v))) as v, f.video_id, coalesce(f.shot_id, 0) as shot_id from p join f on p.video_id = f.video_id and p.keyframe_n = f.keyframe_n),
pe as (select video_id, shot_id, unnest(v) as x, generate_subscripts(v, 1) as i from pv),
pa as (select video_id, shot_id, i, avg(x) as x from pe group by all),
pm as (select video_id, shot_id, list_transform(v, lambda x: cast(cast(x / sqrt(list_inner_product(v, v)) as float) as double)) as v from (select video_id, shot_id, list(x order by i) as v from pa group by all)),
pk as (select pm.*, k.id from pm join (select video_id, shot_id, min(id) as id from pv group by all) k on pm.video_id = k.video_id and pm.shot_id = k.shot_id),
ch as (select query_id, id, score, rank, video_id, shot_id from (select q.id as query_id, pk.id, pk.video_id, pk.shot_id, round(list_cosine_similarity(q.v, pk.v), 6) as score,
  row_number() over (partition by q.id order by round(list_cosine_similarity(q.v, pk.v), 6) desc, pk.id) as rank from (select * from p where id % 100 = 0) q cross join pk) where rank <= {k})"""


def _weights_sql(name: str, docs: str, key: str = "id") -> str:
    """``name`` (key, token, weight) of ``docs`` (key, t)."""
    return f"""{name}_t as (select {key}, unnest(list_filter(regexp_extract_all(lower(nfc_normalize(t)), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: length(x) <= 24)) as token from ({docs})),
{name}_b as (select {key}, token, 1.0 as w from {name}_t union all select {key}, replace(strip_accents(token), 'đ', 'd'), 0.5 from {name}_t where replace(strip_accents(token), 'đ', 'd') <> token),
{name} as (select {key}, token, cast(sum(w) as double) as weight from {name}_b group by all)"""


QUERY_WORDS = _weights_sql("qw", "select m.point_id as query_id, f.caption_vi as t from (select distinct point_id, video_id, keyframe_n from frame_vectors where point_id % 100 = 0) m join f on f.video_id = m.video_id and f.keyframe_n = m.keyframe_n where f.caption_vi is not null", "query_id")


def _sparse_sql(name: str, docs: str, k: int) -> str:
    """``name`` (query_id, id, score, rank): needs qw."""
    return f"""{_weights_sql(name + "_w", docs)},
{name}_i as (select token, count(*) as df, ln(1 + ((select count(distinct id) from {name}_w) - count(*) + 0.5) / (count(*) + 0.5)) as idf from {name}_w group by token),
{name} as (select query_id, id, score, rank from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank
  from (select qw.query_id, w.id, round(sum(qw.weight * i.idf * w.weight), 6) as score from qw join {name}_i i using (token) join {name}_w w using (token) group by all)) where rank <= {k})"""


OCR_DOCS = "select key as id, ocr_text as t from f where ocr_text is not null"
CAPTION_DOCS = "select key as id, caption_vi as t from f where caption_vi is not null"
SPEECH_DOCS = "select id, text_corrected as t from s where text_corrected is not null"


def _dedupe_sql(src: str, keys: str, k: int, shot: str = "shot_id") -> str:
    return f"""select query_id, rank, video_id, shot_id, id, score from (select *, row_number() over (partition by query_id order by score desc, video_id, shot_id, id) as rank
  from (select * exclude (rank), row_number() over (partition by query_id, {keys} order by score desc, video_id, shot_id, id) as rn from {src}) where rn = 1) where rank <= {k}"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts)


def _norm_sql(src: str, keys: str, score: str = "score") -> str:
    return f"select {keys}, case when max({score}) over (partition by query_id) <= min({score}) over (partition by query_id) then 1.0 else ({score} - min({score}) over (partition by query_id)) / (max({score}) over (partition by query_id) - min({score}) over (partition by query_id)) end as score from {src}"


FUSED_SPEECH = f"""{_sparse_sql("sh", SPEECH_DOCS, 50)},
sp as (select sh.query_id, sh.score, s.video_id, s.segment, s.start_sec, s.end_sec, s.speech_score from sh join s on sh.id = s.id),
sn as ({_norm_sql("sp", "query_id, video_id, segment")}),
sc as ({_norm_sql("(select * from sp where speech_score is not null)", "query_id, video_id, segment", "speech_score")}),
fs as (select x.query_id, x.video_id, x.segment, x.score, sp.start_sec, sp.end_sec from (select query_id, video_id, segment, sum(part) as score from (select * exclude (score), 0.7 * score as part from sn union all select * exclude (score), 0.3 * score from sc) group by all) x
  join sp on sp.query_id = x.query_id and sp.video_id = x.video_id and sp.segment = x.segment)"""
BONUS = f"""bn as ({_norm_sql("fs", "query_id, video_id, segment, start_sec, end_sec")}),
bx as (select hf.query_id, hf.id, max(bn.score) as bonus from hf join bn on hf.query_id = bn.query_id and hf.video_id = bn.video_id and bn.start_sec <= hf.high + 1 and bn.end_sec >= hf.low - 1 and bn.end_sec >= bn.start_sec where hf.high >= hf.low group by all),
bh as (select hf.* exclude (score), hf.score + 0.3 * coalesce(bx.bonus, 0) as score from hf left join bx on hf.query_id = bx.query_id and hf.id = bx.id)"""
NEAREST_FRAME = """nf as (select * from (select fs.query_id, fs.video_id, fs.segment, round(fs.score, 6) as score, coalesce(f.shot_id, 0) as shot_id, f.original_frame_id as frame_id,
  row_number() over (partition by fs.query_id, fs.video_id, fs.segment order by abs(f.pts_sec - (fs.start_sec + fs.end_sec) / 2), f.original_frame_id, coalesce(f.shot_id, 0)) as rn
  from fs join f on f.video_id = fs.video_id and f.low <= fs.end_sec and f.high >= fs.start_sec where fs.end_sec >= fs.start_sec and f.high >= f.low and f.pts_sec is not null and f.original_frame_id is not null) where rn = 1),
nb as (select query_id, video_id, shot_id, segment, frame_id, score from (select *, row_number() over (partition by query_id, video_id, shot_id order by score desc, segment, frame_id) as r2 from nf) where r2 = 1)"""
EVENTS = """eh as (select query_id // 300 as query_id, cast((query_id // 100) % 3 as int) as event, video_id, shot_id, frame_id, pts_sec, id, score from hf where frame_id is not null),
sl as (select * from (select *, row_number() over (partition by query_id, event, video_id order by score desc, frame_id, id) as place from eh) where place <= 20)"""
STAGE_A = """ov as (select query_id // 300 as query_id, video_id, max(score) as score from ch where (query_id // 100) % 3 = 0 group by all),
ev as (select query_id, event, video_id, max(score) as score from eh group by all),
av as (select query_id, video_id from ov union select query_id, video_id from ev),
ac as (select av.query_id, av.video_id, coalesce(ov.score, 0) as o, coalesce(a.score, 0) as e0, coalesce(b.score, 0) as e1, coalesce(c.score, 0) as e2 from av left join ov using (query_id, video_id)
  left join (select * from ev where event = 0) a using (query_id, video_id) left join (select * from ev where event = 1) b using (query_id, video_id) left join (select * from ev where event = 2) c using (query_id, video_id)),
sa as (select * from (select *, o + (e0 + e1 + e2) / 3 as score, row_number() over (partition by query_id order by round(o + (e0 + e1 + e2) / 3, 9) desc, video_id) as rank from ac) where rank <= 100),
sv as (select sl.* from sl semi join sa using (query_id, video_id))"""
SEQUENCE = """sq as (select a.query_id, a.video_id, a.frame_id as f0, b.frame_id as f1, c.frame_id as f2, a.pts_sec as t0, b.pts_sec as t1, c.pts_sec as t2,
  (a.score + b.score + c.score - 0.05 * 3 / 2.0 * (case when b.pts_sec - a.pts_sec > 0 then ln(1 + b.pts_sec - a.pts_sec) / ln(301) else 0 end + case when c.pts_sec - b.pts_sec > 0 then ln(1 + c.pts_sec - b.pts_sec) / ln(301) else 0 end)) / 3 as score
  from (select * from sv where event = 0) a join (select * from sv where event = 1) b on a.query_id = b.query_id and a.video_id = b.video_id and a.frame_id < b.frame_id and coalesce(b.pts_sec - a.pts_sec, 0) <= 300
  join (select * from sv where event = 2) c on b.query_id = c.query_id and b.video_id = c.video_id and b.frame_id < c.frame_id and coalesce(c.pts_sec - b.pts_sec, 0) <= 300),
bs as (select * from (select *, row_number() over (partition by query_id, video_id order by round(score, 12) desc, f2, f1, f0) as r from sq) where r = 1)"""
ALTERNATES = """pq as (select query_id, video_id, 0 as event, f0 as chosen, null::bigint as bf, null::double as bt, f1 as af, t1 as aft from bs union all select query_id, video_id, 1, f1, f0, t0, f2, t2 from bs union all select query_id, video_id, 2, f2, f1, t1, null, null from bs),
al as (select sv.query_id, sv.video_id, sv.event, sv.frame_id, sv.score, sv.score - 0.05 * (case when sv.pts_sec - bt > 0 then ln(1 + sv.pts_sec - bt) / ln(301) else 0 end + case when aft - sv.pts_sec > 0 then ln(1 + aft - sv.pts_sec) / ln(301) else 0 end) as worth
  from sv join pq on sv.query_id = pq.query_id and sv.video_id = pq.video_id and sv.event = pq.event where sv.frame_id <> chosen and (bf is null or (bf < sv.frame_id and coalesce(sv.pts_sec - bt, 0) <= 300)) and (af is null or (sv.frame_id < af and coalesce(aft - sv.pts_sec, 0) <= 300)))"""

H50, HF = _hits_sql(50), HIT_FRAMES
SQL = {
    "knn_topk": _with(POINTS, _hits_sql(10)) + " select * from h",
    "knn_filtered": _with(POINTS, _hits_sql(5, "video_id in ('L01_V001', 'L02_V001', 'L03_V002')")) + " select * from h",
    "dedupe_shot": _with(POINTS, FRAMES, H50, HF) + _dedupe_sql("hf", "video_id, shot_id", 10),
    "dedupe_video": _with(POINTS, FRAMES, H50, HF) + _dedupe_sql("hf", "video_id", 10),
    "kis_visual": _with(POINTS, FRAMES, _hits_sql(100), HF) + _dedupe_sql("hf", "video_id, shot_id", 20),
    "overfetch_dedupe": _with(POINTS, FRAMES, _hits_sql(20), HF) + _dedupe_sql("hf", "video_id, shot_id", 4),
    "minmax_normalize": _with(POINTS, _hits_sql(20)) + f" select query_id, id, round(score, 6) as score from ({_norm_sql('h', 'query_id, id')})",
    "frame_clip_fusion": _with(POINTS, FRAMES, H50, HF, CLIP_HITS.format(k=30)) + """, fb as (select query_id, video_id, shot_id, frame_id, score as f from (select *, row_number() over (partition by query_id, video_id, shot_id order by score desc, id) as rn from hf) where rn = 1),
cb as (select query_id, video_id, shot_id, max(score) as c from ch group by all), cm as (select query_id, min(c) as cm from cb group by all), fm as (select query_id, min(f) as fm from fb group by all)
select query_id, video_id, shot_id, fb.frame_id, round((coalesce(f, fm, 0) + 0.5 * coalesce(c, cm)) * 1e7) / 1e7 as score from fb full join cb using (query_id, video_id, shot_id) left join fm using (query_id) left join cm using (query_id) where cm is not null
union all select query_id, video_id, shot_id, frame_id, round(score * 1e7) / 1e7 from hf where query_id not in (select query_id from ch)""",
    "rrf_two_list": _with(POINTS, FRAMES, H50, HF, QUERY_WORDS, _sparse_sql("oh", OCR_DOCS, 50)) + f""", of as (select oh.*, f.video_id, coalesce(f.shot_id, 0) as shot_id, f.original_frame_id as frame_id, f.ocr_text from oh join f on oh.id = f.key),
a as (select d.*, hf.frame_id, hf.ocr_text from ({_dedupe_sql("hf", "video_id, shot_id", 1000)}) d join hf on hf.query_id = d.query_id and hf.id = d.id), b as (select d.*, of.frame_id, of.ocr_text from ({_dedupe_sql("of", "video_id, shot_id", 1000)}) d join of on of.query_id = d.query_id and of.id = d.id)
select query_id, video_id, shot_id, case when a.rank is not null then a.frame_id else b.frame_id end as frame_id, coalesce(a.ocr_text, b.ocr_text) as ocr_text, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(0.05 / (60 + b.rank), 0), 8) as score from a full join b using (query_id, video_id, shot_id) where query_id in (select query_id from of)
union all select query_id, video_id, shot_id, frame_id, ocr_text, round(score, 8) from hf where query_id not in (select query_id from of)""",
    "rrf_multi_list": _with(POINTS, FRAMES, H50, HF, QUERY_WORDS, _sparse_sql("oh", OCR_DOCS, 50), _sparse_sql("cp", CAPTION_DOCS, 50)) + """ select query_id, id, round(sum(part), 8) as score from (select query_id, id, 1.0 / (60 + rank) as part from hf union all select query_id, id, 1.0 / (60 + rank) from oh union all select query_id, id, 1.0 / (60 + rank) from cp) group by all""",
    "token_tf": _with(FRAMES, _weights_sql("w", OCR_DOCS)) + " select id, token, weight from w",
    "token_df": _with(FRAMES, _weights_sql("w", OCR_DOCS)) + " select token, count(*) as df, round(ln(1 + ((select count(distinct id) from w) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from w group by token",
    "idf_sparse_topk": _with(FRAMES, QUERY_WORDS, _sparse_sql("oh", OCR_DOCS, 10)) + " select * from oh",
    "ocr_search": _with(FRAMES, QUERY_WORDS, _sparse_sql("oh", OCR_DOCS, 50)) + f", of as (select oh.*, f.video_id, coalesce(f.shot_id, 0) as shot_id from oh join f on oh.id = f.key) {_dedupe_sql('of', 'video_id, shot_id', 10)}",
    "asr_weighted_fusion": _with(FRAMES, SPEECH, QUERY_WORDS, FUSED_SPEECH) + " select query_id, video_id, segment, round(score, 6) as score from fs",
    "speech_overlap_bonus": _with(POINTS, FRAMES, SPEECH, H50, HF, QUERY_WORDS, FUSED_SPEECH, BONUS) + " select query_id, id, round(score, 6) as score from bh",
    "kis_visual_asr": _with(POINTS, FRAMES, SPEECH, H50, HF, QUERY_WORDS, FUSED_SPEECH, BONUS) + f", br as (select * exclude (score), round(score, 6) as score from bh) {_dedupe_sql('br', 'video_id, shot_id', 10)}",
    "asr_nearest_frame": _with(FRAMES, SPEECH, QUERY_WORDS, FUSED_SPEECH, NEAREST_FRAME) + " select * from nb",
    "asr_only": _with(FRAMES, SPEECH, QUERY_WORDS, FUSED_SPEECH, NEAREST_FRAME) + " select * from (select *, row_number() over (partition by query_id order by score desc, video_id, segment, frame_id) as rank from nb) where rank <= 20",
    "rerank_head": _with(POINTS, FRAMES, H50, HF) + f""", d as ({_dedupe_sql("hf", "video_id, shot_id", 10)}), t as (select d.*, length(coalesce(f.ocr_text, '')) / 1000.0 + 1.0 / (10 + d.rank) as n, count(*) over (partition by query_id) as c from d left join f on f.key = d.id),
u as (select query_id, id, rank as old, case when rank <= 5 then 0 else 1 end as block, case when rank <= 5 and least(c, 5) >= 2 then n else score end as score from t)
select query_id, block, id, round(score, 6) as score, row_number() over (partition by query_id order by block, case when block = 0 then -score end, old) as rank from u""",
    "neighbours": _with(FRAMES) + """, n as (select video_id, keyframe_n, shot_id, original_frame_id, row_number() over (partition by video_id order by original_frame_id, keyframe_n) as pos from f where original_frame_id is not null)
select b.video_id, c.keyframe_n as chosen_n, b.keyframe_n, b.shot_id, b.original_frame_id, b.shot_id = c.shot_id as is_same_shot from n c join n b on b.video_id = c.video_id and b.pos between c.pos - 2 and c.pos + 2""",
}
SQL["hybrid_search"] = SQL["rrf_multi_list"].replace(" select query_id, id, round(sum(part), 8)", ", r as (select query_id, id, round(sum(part), 8)") + f"), of as (select r.*, 0 as rank, f.video_id, coalesce(f.shot_id, 0) as shot_id from r join f on r.id = f.key) {_dedupe_sql('of', 'video_id, shot_id', 20)}"
#: Every pair of a query and a point, ranked: no pool.
_ALL_HITS = _with(POINTS, FRAMES, _hits_sql(2**62), HF)
_TRAKE = _with(POINTS, FRAMES, _hits_sql(2**62), HF, CLIP_HITS.format(k=2**62), EVENTS, STAGE_A)
_PICKS = "concat_ws(',', f0, f1, f2) as frames"
SQL |= {
    "video_max_score": _ALL_HITS + " select query_id, video_id, score from (select query_id, video_id, max(score) as score, row_number() over (partition by query_id order by max(score) desc, video_id) as r from hf group by query_id, video_id) where r <= 1000",
    "stage_a_videos": _TRAKE + " select query_id, video_id, round(score, 6) as score, round(o, 6) as overview_score, printf('%.6f', e0) || ',' || printf('%.6f', e1) || ',' || printf('%.6f', e2) as event_scores from sa",
    "topn_per_video": _TRAKE + " select query_id, event, video_id, place, frame_id, id, score from sv",
    "trake_sequence": f"{_TRAKE}, {SEQUENCE} select query_id, video_id, round(score, 6) as score, {_PICKS} from bs",
    "trake_alternates": f"{_TRAKE}, {SEQUENCE}, {ALTERNATES} select query_id, video_id, event, place, frame_id, round(score, 6) as score from (select *, row_number() over (partition by query_id, video_id, event order by round(worth, 9) desc, frame_id) as place from al) where place <= 5",
    "trake_search": f"{_TRAKE}, {SEQUENCE} select bs.query_id, rk.rank, bs.video_id, round(bs.score, 6) as score, sa.rank as video_rank, {_PICKS} from bs join (select query_id, video_id, row_number() over (partition by query_id order by round(score, 6) desc, video_id) as rank from bs) rk using (query_id, video_id) join sa on sa.query_id = bs.query_id and sa.video_id = bs.video_id where rk.rank <= 20",
}
