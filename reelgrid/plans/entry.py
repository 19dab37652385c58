"""The entry points of a search: one configuration, and result rows of one shape for every track.

A result row is rank, video_id, frame_ids, score, ocr_text, and where they apply stage_a (why the video
was searched), events (the frame of each event with those it beat) and asr_evidence (the segment that
speech alone found). Vectors and words of the queries are given; making them is the models' part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.operators import filters, per_video, ranking, search, sequence, temporal
from reelgrid.operators.lexical import LexicalIndex, query_terms
from reelgrid.session import kept

MODES = ("visual", "visual_asr", "asr_only")
_CANDIDATE = "frame_id: bigint, shot_id: int, pts_sec: double, score: double"
STAGE_A = "struct<rank: int, score: double, overview_score: double, event_scores: array<double>>"
EVENTS = f"array<struct<event_index: int, {_CANDIDATE}, alternates: array<struct<{_CANDIDATE}>>>>"
EVIDENCE = "struct<segment: int, text: string, start_sec: double, end_sec: double, score: double>"
SCHEMA = {"ocr_text": "string", "stage_a": STAGE_A, "events": EVENTS, "asr_evidence": EVIDENCE}


@dataclass(frozen=True)
class RetrievalConfig:
    """What a search does; a weight of 0 or a missing table leaves its stage out."""

    dim: int
    clip_weight: float = ranking.CLIP_WEIGHT
    ocr_boost_enabled: bool = False
    ocr_boost_weight: float = ranking.SECOND_WEIGHT
    asr_enabled: bool = True
    asr_weight: float = 0.3
    asr_dense_weight: float = 0.7
    asr_sparse_weight: float = 0.3
    asr_pad_sec: float = 1.0
    asr_top_k: int = 200
    rerank_top_n: int = ranking.HEAD
    stage_a_videos: int = 100
    per_video: int = sequence.PER_VIDEO
    alternates: int = sequence.ALTERNATES
    max_gap_sec: float = 300.0
    gap_weight: float = sequence.GAP_WEIGHT

    def resolved(self, **overrides: object) -> RetrievalConfig:
        """The configuration of one request: what it states replaces the defaults, what is None doesn't."""
        return RetrievalConfig(**(self.__dict__ | {k: v for k, v in overrides.items() if v is not None}))


@dataclass
class Corpus:
    """The tables that are searched.

    ``frames``: point_id, video_id, keyframe_n, id (a number for the keyframe), shot_id, frame_id,
    pts_sec, low, high, ocr_text, v; ``shots``: id, video_id, shot_id, v; ``segments``: id, video_id,
    segment, start_sec, end_sec, text and, if there is one, v.
    """

    frames: DataFrame
    shots: DataFrame | None = None
    segments: DataFrame | None = None
    screen_index: LexicalIndex | None = None
    speech_index: LexicalIndex | None = None


@dataclass
class Timings:
    """Milliseconds by stage; a stage that runs again adds to its own."""

    values: dict[str, float] = field(default_factory=dict)

    def timed(self, stage: str, run: Callable[[], DataFrame]) -> DataFrame:
        began = perf_counter()
        out = kept(run())
        self.values[stage] = self.values.get(stage, 0.0) + (perf_counter() - began) * 1000
        return out

    def rounded(self) -> dict[str, float]:
        return {k: round(v, 3) for k, v in self.values.items()}


def _result(rows: DataFrame, **columns: Column) -> DataFrame:
    filled = {c: columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in SCHEMA.items()}
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "video_id", "frame_ids", "score", *filled.values())


def _words(queries: DataFrame, column: str) -> DataFrame:
    """Terms of the queries' texts; a query of blanks alone has none, so nothing is searched for it."""
    return query_terms(queries.select("query_id", F.col(column).alias("t")).where(F.trim(F.coalesce("t", F.lit(""))) != ""))


def speech_branches(queries: DataFrame, corpus: Corpus, config: RetrievalConfig, k: int) -> list[tuple[DataFrame, float]]:
    """The speech search's lists with their weights, kept apart: by vectors, where segments and queries have them, and by words."""
    columns = ["query_id", "video_id", "segment", "score"]
    place = corpus.segments.select("id", "video_id", "segment")
    out = []
    if config.asr_dense_weight > 0 and "v" in corpus.segments.columns and "speech_v" in queries.columns:
        q = queries.where("speech_v is not null").select("query_id", F.col("speech_v").alias("v"))
        out.append((search.knn(q, corpus.segments.select("id", "v"), k, config.dim, exclude_self=False).join(place, "id").select(columns), config.asr_dense_weight))
    if config.asr_sparse_weight > 0 and corpus.speech_index is not None:
        out.append((corpus.speech_index.search(_words(queries, "speech"), k).join(place, "id").select(columns), config.asr_sparse_weight))
    return out


def speech_search(queries: DataFrame, corpus: Corpus, config: RetrievalConfig, k: int | None = None) -> DataFrame:
    """(query_id, video_id, segment, score, start_sec, end_sec, text): both branches min-max normalised and added by weight."""
    branches = [(kept(h), w) for h, w in speech_branches(queries, corpus, config, k or config.asr_top_k)]
    keys = ["query_id", "video_id", "segment"]
    if not branches:
        empty = corpus.segments.limit(0)
        return empty.select(F.lit(0).cast("bigint").alias("query_id"), "video_id", "segment", F.lit(0.0).alias("score"), "start_sec", "end_sec", "text")
    return kept(ranking.weighted_fusion(branches, keys).join(corpus.segments.select("video_id", "segment", "start_sec", "end_sec", "text"), ["video_id", "segment"]))


def _frame_hits(queries: DataFrame, corpus: Corpus, config: RetrievalConfig, k: int) -> DataFrame:
    frames = corpus.frames.drop("v")
    hits = search.knn(queries.select("query_id", "v"), corpus.frames.select(F.col("point_id").alias("id"), "v"), k, config.dim, exclude_self=False)
    return hits.drop("rank").withColumnRenamed("id", "point_id").join(frames, "point_id").withColumn("shot_id", F.coalesce("shot_id", F.lit(0)))


def _ranked_frames(queries: DataFrame, corpus: Corpus, config: RetrievalConfig, top_k: int, mode: str, timings: Timings) -> DataFrame:
    wide = search.overfetch_limit(top_k)
    hits = timings.timed("search", lambda: _frame_hits(queries, corpus, config, wide))
    if corpus.shots is not None and config.clip_weight > 0:
        clips = search.knn(queries.select("query_id", "v"), corpus.shots.select("id", "v"), wide, config.dim, exclude_self=False).drop("rank")
        none = {c: F.lit(None).cast(hits.schema[c].dataType) for c in ("frame_id", "pts_sec", "low", "high", "ocr_text")}
        clips = clips.join(corpus.shots.select("id", "video_id", "shot_id"), "id").withColumns(none)
        hits = timings.timed("clips", lambda: ranking.fuse_frames_and_clips(hits, clips, config.clip_weight))
    if config.ocr_boost_enabled and corpus.screen_index is not None and "text" in queries.columns:
        found = corpus.screen_index.search(_words(queries, "text"), wide).join(corpus.frames.drop("v").dropDuplicates(["id"]), "id").withColumn("shot_id", F.coalesce("shot_id", F.lit(0)))
        hits = timings.timed("ocr", lambda: ranking.rrf_two(hits, found, config.ocr_boost_weight))
    if mode == "visual_asr" and config.asr_weight > 0 and corpus.segments is not None:
        speech = timings.timed("speech", lambda: speech_search(queries, corpus, config))
        hits = timings.timed("bonus", lambda: ranking.speech_bonus(hits, speech, config.asr_weight, config.asr_pad_sec))
    return ranking.dedupe_by_shot(hits, top_k)


def search_frames(queries: DataFrame, corpus: Corpus, config: RetrievalConfig, top_k: int = 20, mode: str | None = None, rerank: Column | None = None, timings: Timings | None = None) -> DataFrame:
    """The frames of every query: one hit per shot, one frame per hit. Known-item search and questions are both this.

    ``queries``: query_id, v, and where words are searched text (on screen) and speech (said), speech_v.
    ``mode``: visual, visual_asr (default where there is speech) or asr_only.
    """
    timings = timings or Timings()
    mode = mode or ("visual_asr" if config.asr_enabled and corpus.segments is not None and config.asr_weight > 0 else "visual")
    if mode not in MODES:
        raise ValueError(f"no mode {mode}; there are {', '.join(MODES)}")
    if mode == "asr_only":
        return _speech_alone(queries, corpus, config, top_k, timings)
    hits = _ranked_frames(queries, corpus, config, top_k, mode, timings)
    if rerank is not None:
        hits = ranking.rerank_head(hits, rerank, config.rerank_top_n).withColumn("rank", F.col("new_rank"))
    return _result(hits.withColumn("frame_ids", F.array(F.coalesce("frame_id", F.lit(0)))), ocr_text=F.col("ocr_text") if config.ocr_boost_enabled else F.lit(None))


search_kis = search_frames
search_qa = search_frames


def _speech_alone(queries: DataFrame, corpus: Corpus, config: RetrievalConfig, top_k: int, timings: Timings) -> DataFrame:
    if corpus.segments is None or not config.asr_enabled:
        raise ValueError("speech isn't searched in this configuration")
    speech = timings.timed("speech", lambda: speech_search(queries, corpus, config))
    frames = filters.in_list(corpus.frames.drop("v"), "video_id", speech.select("video_id").distinct())
    near = temporal.segments_to_frames(speech.where("end_sec >= start_sec"), frames.select("video_id", F.coalesce("shot_id", F.lit(0)).alias("shot_id"), "frame_id", "pts_sec", "low", "high"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "video_id", "segment", "frame_id")
    top = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).withColumn("frame_ids", F.array("frame_id"))
    return _result(top, asr_evidence=F.struct("segment", "text", "start_sec", "end_sec", "score"))


def search_ocr(queries: DataFrame, corpus: Corpus, config: RetrievalConfig, top_k: int = 20) -> DataFrame:
    """Frames by the words on screen alone, one hit per shot. ``queries``: query_id, text."""
    found = corpus.screen_index.search(_words(queries, "text"), search.overfetch_limit(top_k))
    hits = found.drop("rank").join(corpus.frames.drop("v").dropDuplicates(["id"]), "id").withColumn("shot_id", F.coalesce("shot_id", F.lit(0)))
    ranked = ranking.dedupe_by_shot(hits, top_k)
    return _result(ranked.withColumn("frame_ids", F.array(F.coalesce("frame_id", F.lit(0)))), ocr_text=F.col("ocr_text"))


def search_trake(queries: DataFrame, corpus: Corpus, config: RetrievalConfig, n_events: int, top_k: int = 20, videos: DataFrame | None = None, single_frame: bool = False) -> DataFrame:
    """Ordered event sequences. ``queries``: query_id, event (0-based, -1 the overview), point_id (null if it is none of the corpus), v.

    ``videos`` (query_id, video_id) names the videos to search; then stage_a is null. ``single_frame``:
    frame_ids holds the best-scoring event's frame alone, which is the answer of a known-item search.
    """
    q = kept(queries)
    base = corpus.frames.where("frame_id is not null").withColumn("shot_id", F.coalesce("shot_id", F.lit(0)))
    chosen = None
    if videos is None:
        shots = None if corpus.shots is None else corpus.shots.select("video_id", "v")
        chosen = kept(per_video.videos_by_score(q, corpus.frames, config.stage_a_videos, n_events, shots))
        videos = chosen.select("query_id", "video_id")
    events = q.where(F.col("event") >= 0)
    s = kept(per_video.sequences_of_videos(videos, events, base, n_events, config.per_video, config.max_gap_sec, config.gap_weight))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "video_id")
    top = kept(s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k))
    slots = kept(per_video.slots_of_videos(top.select("query_id", "video_id"), events, base, config.per_video))
    beaten = sequence.alternates(slots, top, config.max_gap_sec, config.gap_weight, config.alternates)
    told = slots.groupBy("query_id", "video_id", "event", "frame_id").agg(F.min_by(F.struct("shot_id", "pts_sec"), "id").alias("f"))
    listed = beaten.join(told, ["query_id", "video_id", "event", "frame_id"]).groupBy("query_id", "video_id", "event").agg(F.array_sort(F.collect_list(F.struct("place", F.struct("frame_id", "f.shot_id", "f.pts_sec", "score").alias("c")))).alias("a"))
    each = top.select("query_id", "video_id", F.posexplode("picks").alias("event", "pick")).join(listed, ["query_id", "video_id", "event"], "left")
    event = F.struct(F.col("event").alias("event_index"), "pick.frame_id", "pick.shot_id", "pick.pts_sec", "pick.score", F.coalesce(F.col("a.c"), F.array().cast(f"array<struct<{_CANDIDATE}>>")).alias("alternates"))
    rows = top.join(each.groupBy("query_id", "video_id").agg(F.array_sort(F.collect_list(event)).alias("events")), ["query_id", "video_id"])
    frames = F.col("picks.frame_id")
    if single_frame:
        best = F.aggregate("picks", F.col("picks")[0], lambda a, p: F.when(p["score"] > a["score"], p).otherwise(a))
        frames = F.array(best["frame_id"])
    rows = rows.withColumn("frame_ids", frames)
    if chosen is not None:
        rows = rows.join(chosen.select("query_id", "video_id", F.struct("rank", "score", "overview_score", "event_scores").alias("stage_a")), ["query_id", "video_id"])
    return _result(rows, events=F.col("events"), **({"stage_a": F.col("stage_a")} if chosen is not None else {}))
