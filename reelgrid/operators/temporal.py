"""Joins in time: as-of, containment, nearest, overlap.

The as-of join never sorts a whole video in one task: rows are bucketed by time, each bucket looks
back into itself, and what the earlier buckets end with is carried over a table of one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_at_or_before(left: DataFrame, right: DataFrame, by: str, at: str, start: str, payload: list[str], bucket: float) -> DataFrame:
    """Each left row with STRUCT ``found``: the right row of the greatest ``start`` not after ``at``.

    Of equal starts the greatest payload. Null keys or times find nothing.
    """
    r = right.where(F.col(by).isNotNull() & F.col(start).isNotNull()).select(F.col(by).alias("_k"), F.col(start).cast("double").alias("_t"), F.floor(F.col(start) / bucket).alias("_b"), F.struct(F.col(start), *payload).alias("_p"))
    lefts = left.withColumn("_k", F.col(by)).withColumn("_t", F.col(at).cast("double")).withColumn("_b", F.floor(F.col(at) / bucket))
    ends = r.groupBy("_k", "_b").agg(F.max_by("_p", F.struct("_t", "_p")).alias("_e"))
    marks = ends.unionByName(lefts.where("_k is not null and _b is not null").select("_k", "_b").distinct(), allowMissingColumns=True).groupBy("_k", "_b").agg(F.max("_e").alias("_e"))
    # One row per (key, bucket).
    before = marks.withColumn("_c", F.last("_e", True).over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select("_k", "_b", "_c")
    both = lefts.select("*", F.lit(1).alias("_side")).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy("_k", "_b").orderBy("_t", "_side", F.col("_p").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_f", F.last("_p", True).over(w)).where("_side = 1").drop("_side", "_p")
    return seen.join(before, ["_k", "_b"], "left").withColumn("found", F.coalesce("_f", "_c")).drop("_k", "_t", "_b", "_f", "_c")


def with_next(shots: DataFrame, by: str, order: list[str], payload: list[str]) -> DataFrame:
    """Shots with the following shot's payload (next_*) and whether it is the first of its key."""
    w = W.partitionBy(by).orderBy(*order)
    return shots.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in payload], F.row_number().over(w).alias("position"))


def shot_of_frame(frames: DataFrame, shots: DataFrame, frame: str, mode: str = "snap", bucket: float = 4000.0) -> DataFrame:
    """Frames with ``found_shot``: the shot whose [start_frame, end_frame] holds the frame.

    Where none does: 'strict' null; 'snap' the following shot, the last one at the end, the first one
    before all. ``shots``: video_id, shot_id, start_frame, end_frame.
    """
    s = with_next(shots, "video_id", ["start_frame", "end_frame", "shot_id"], ["shot_id"])
    out = last_at_or_before(frames, s, "video_id", frame, "start_frame", ["end_frame", "shot_id", "next_shot_id"], bucket)
    inside = F.col(frame) <= F.col("found.end_frame")
    if mode == "strict":
        return out.withColumn("found_shot", F.when(inside, F.col("found.shot_id"))).drop("found")
    first = s.where("position = 1").select("video_id", F.col("shot_id").alias("_first"))
    snapped = F.when(inside, F.col("found.shot_id")).when(F.col("found").isNotNull(), F.coalesce("found.next_shot_id", "found.shot_id")).otherwise(F.col("_first"))
    return out.join(first, "video_id", "left").withColumn("found_shot", F.when(F.col(frame).isNotNull(), snapped)).drop("found", "_first")


def nearest_shot(instants: DataFrame, shots: DataFrame, at: str, bucket: float = 120.0) -> DataFrame:
    """Instants with ``found_shot``: the shot that holds the instant, else the one whose bounds are nearest, ties to the earlier.

    ``shots``: video_id, shot_id, start_sec, end_sec.
    """
    s = with_next(shots, "video_id", ["start_sec", "end_sec", "shot_id"], ["shot_id", "start_sec", "end_sec"])
    out = last_at_or_before(instants, s, "video_id", at, "start_sec", ["end_sec", "shot_id", "next_shot_id", "next_start_sec", "next_end_sec"], bucket)
    first = s.where("position = 1").select("video_id", F.col("shot_id").alias("_first"))
    away = lambda a, b: F.least(F.abs(F.col(at) - F.col(a)), F.abs(F.col(at) - F.col(b)))
    here, there = away("found.start_sec", "found.end_sec"), away("found.next_start_sec", "found.next_end_sec")
    pick = F.when(F.col(at) <= F.col("found.end_sec"), F.col("found.shot_id")).when(F.col("found").isNull(), F.col("_first")).when(there < here, F.col("found.next_shot_id")).otherwise(F.col("found.shot_id"))
    return out.join(first, "video_id", "left").withColumn("found_shot", F.when(F.col(at).isNotNull(), pick)).drop("found", "_first")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket: float, closed: bool = True) -> DataFrame:
    """All pairs of rows of one key whose spans overlap, each pair once; ends included if ``closed``.

    Spans are cut into buckets that both sides share, which bounds what meets in one task; a pair is
    kept only in the first bucket that both are in. Rows with a null or reversed span pair with nothing.
    """
    (a, b), (c, d) = left_span, right_span
    slots = lambda x, y: F.sequence(F.floor(F.col(x) / bucket), F.floor(F.col(y) / bucket))
    lefts = left.where(F.col(b) >= F.col(a)).withColumn("_lo", F.floor(F.col(a) / bucket)).withColumn("_slot", F.explode(slots(a, b)))
    rights = right.where(F.col(d) >= F.col(c)).withColumn("_ro", F.floor(F.col(c) / bucket)).withColumn("_slot", F.explode(slots(c, d)))
    meets = (F.col(c) <= F.col(b)) & (F.col(d) >= F.col(a)) if closed else (F.col(c) < F.col(b)) & (F.col(d) > F.col(a))
    return lefts.join(rights, [*by, "_slot"]).where(meets & (F.col("_slot") == F.greatest("_lo", "_ro"))).drop("_slot", "_lo", "_ro")


def overlapping_semi(left: DataFrame, right: DataFrame, by: list[str], keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket: float) -> DataFrame:
    """The rows of ``left`` (named by ``keys``) that any right span overlaps, ends included: a semi-join, no pairs are made."""
    (a, b), (c, d) = left_span, right_span
    slots = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / bucket), F.floor(F.col(y) / bucket)))
    lefts = left.where(F.col(b) >= F.col(a)).withColumn("_slot", slots(a, b))
    rights = right.where(F.col(d) >= F.col(c)).select(*by, F.col(c).alias("_c"), F.col(d).alias("_d"), slots(c, d).alias("_slot"))
    met = lefts.alias("l").join(rights.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*by, "_slot"]] + [F.col("_c") <= F.col(b), F.col("_d") >= F.col(a)], "left_semi")
    return met.drop("_slot").dropDuplicates(keys)  # a span that is in several slots is met in each


def inside_window(left: DataFrame, right: DataFrame, by: list[str], window: tuple[str, str], at: str, bucket: float) -> DataFrame:
    """All pairs in which the right row's instant lies in the left row's window, ends included."""
    a, b = window
    lefts = left.where(F.col(b) >= F.col(a)).withColumn("_slot", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    rights = right.where(F.col(at).isNotNull()).withColumn("_slot", F.floor(F.col(at) / bucket))
    return lefts.join(rights, [*by, "_slot"]).where(F.col(at).between(F.col(a), F.col(b))).drop("_slot")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order of non-null columns, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])


def texts_in_window(windows: DataFrame, spans: DataFrame, keys: list[str], window: tuple[str, str], text: str, bucket: float = 60.0) -> DataFrame:
    """(keys, joined): the texts of spans that overlap the half-open window, in order of start, with blanks between."""
    pairs = overlapping(windows, spans, ["video_id"], window, ("start_sec", "end_sec"), bucket, closed=False)
    parts = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_sec", "segment", F.col(text).alias("t")))).alias("p"))
    return parts.select(*keys, F.concat_ws(" ", F.col("p.t")).alias("joined"))


def entities_in_window(windows: DataFrame, spans: DataFrame, keys: list[str], window: tuple[str, str], entities: str, bucket: float = 60.0) -> DataFrame:
    """(keys, entities): the different entities of spans that overlap the half-open window, in order of first mention."""
    pairs = overlapping(windows, spans, ["video_id"], window, ("start_sec", "end_sec"), bucket, closed=False)
    parts = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_sec", "segment", F.col(entities).alias("e")))).alias("p"))
    return parts.select(*keys, F.array_distinct(F.flatten(F.filter(F.col("p.e"), lambda e: e.isNotNull()))).alias("entities"))


def segments_to_frames(segments: DataFrame, frames: DataFrame, bucket: float = 30.0) -> DataFrame:
    """The keyframe nearest the middle of each segment among those whose window overlaps it, then the best segment per shot.

    ``segments``: query_id, video_id, segment, start_sec, end_sec, score; ``frames``: video_id,
    shot_id, frame_id, pts_sec, low, high. Out: one row per (query_id, video_id, shot_id).
    """
    # What is nearest depends on the span alone, so a segment that many queries found meets the frames once; of frames with the same times only the first can be it.
    span = ["video_id", "start_sec", "end_sec"]
    windows = first_of(frames.where("pts_sec is not null and frame_id is not null").select("video_id", "shot_id", "frame_id", "pts_sec", "low", "high"), ["video_id", "pts_sec", "low", "high"], [F.col("frame_id"), F.col("shot_id")])
    pairs = overlapping(segments.select(*span).distinct(), windows, ["video_id"], ("start_sec", "end_sec"), ("low", "high"), bucket)
    mid = (F.col("start_sec") + F.col("end_sec")) / 2
    found = first_of(pairs.withColumn("away", F.abs(F.col("pts_sec") - mid)), span, [F.col("away"), F.col("frame_id"), F.col("shot_id")])
    near = segments.join(found, span)
    return first_of(near, ["query_id", "video_id", "shot_id"], [-F.col("score"), F.col("segment"), F.col("frame_id")])


def with_time_to_next(frames: DataFrame, bucket: float = 600.0) -> DataFrame:
    """Frames (video_id, keyframe_n, pts_sec, ...) with ``to_next``, the seconds to the next one of the video; null for the last.

    Leads run inside buckets of ``bucket`` seconds, so a day-long video is many tasks; the last frame of a
    bucket finds the first of the next one in a table of one row a bucket.
    """
    f = frames.withColumn("_b", F.floor(F.col("pts_sec") / bucket))
    first = f.groupBy("video_id", "_b").agg(F.min("pts_sec").alias("_first"))
    after = first.select("video_id", "_b", F.lead("_first").over(W.partitionBy("video_id").orderBy("_b")).alias("_after"))
    inside = f.withColumn("_next", F.lead("pts_sec").over(W.partitionBy("video_id", "_b").orderBy("pts_sec", "keyframe_n")))
    joined = inside.join(after, ["video_id", "_b"], "left")
    return joined.withColumn("to_next", F.round(F.coalesce("_next", "_after") - F.col("pts_sec"), 6)).drop("_b", "_next", "_after")
