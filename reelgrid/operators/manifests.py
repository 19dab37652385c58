"""Manifests of keyframes and shots, and where frames of a clip are sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.operators.etl import with_rate
from reelgrid.operators.temporal import shot_of_frame


def keyframe_manifest(files: DataFrame, videos: DataFrame, shots: DataFrame | None = None, fallback: tuple[int, int] | None = None) -> DataFrame:
    """(video_id, shot_id, keyframe_n, original_frame_id, pts_sec, path) of keyframe files, numbered from 1 by frame.

    ``files``: video_id, original_frame_id, path; ``videos``: video_id, fps_num, fps_den, is_vfr. With
    ``shots`` each keyframe gets the shot that holds it, and reading one that none holds is an error;
    without, each keyframe is a shot of its own, numbered from 0, so that nothing is merged by shot.
    """
    w = W.partitionBy("video_id").orderBy("original_frame_id", "path")
    n = files.withColumn("keyframe_n", F.row_number().over(w))
    if shots is None:
        placed = n.withColumn("shot_id", F.col("keyframe_n") - 1)
    else:
        outside = F.raise_error(F.concat(F.lit("keyframe outside every shot: "), F.concat_ws(":", "video_id", "original_frame_id"))).cast("int")
        placed = shot_of_frame(n, shots, "original_frame_id", "strict").withColumn("shot_id", F.coalesce("found_shot", outside))
    rated = with_rate(placed, videos, fallback)
    return rated.select("video_id", "shot_id", "keyframe_n", "original_frame_id", (F.col("original_frame_id") * F.col("fps_den") / F.col("fps_num")).alias("pts_sec"), "path")


def shot_manifest(shots: DataFrame, videos: DataFrame, fallback: tuple[int, int] | None = None) -> DataFrame:
    """(video_id, shot_id, start_frame, end_frame, start_sec, end_sec, path) of a shot list; the path is the video's, else its id."""
    sec = lambda c: F.col(c) * F.col("fps_den") / F.col("fps_num")
    rated = with_rate(shots, videos, fallback).join(videos.select("video_id", F.col("path").alias("_path")), "video_id", "left")
    return rated.select("video_id", "shot_id", "start_frame", "end_frame", sec("start_frame").alias("start_sec"), sec("end_frame").alias("end_sec"), F.coalesce("_path", "video_id").alias("path"))


def sample_times(start_sec: Column, end_sec: Column, start_frame: Column, end_frame: Column, frames: int) -> Column:
    """ARRAY<DOUBLE> of evenly spaced times from start to end, both included; at most as many as the clip has frames, one gives the start."""
    n = F.least(F.lit(frames), end_frame - start_frame + 1).cast("int")
    step = F.try_divide(end_sec - start_sec, n - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, start_sec).when(i == n - 1, end_sec).otherwise(start_sec + i * step)))


def sampled_frames(clips: DataFrame, frames: DataFrame, want: int) -> DataFrame:
    """(video_id, shot_id, position, frame): for each sampled time of a clip the first known frame not earlier, but for half a frame.

    ``clips``: video_id, shot_id, start_frame, end_frame, start_sec, end_sec; ``frames``: video_id,
    frame, at_sec, the frames that could be decoded. Times after the last such frame of the clip
    repeat it; a clip without any gives no row.
    """
    half = F.coalesce(F.try_divide(F.col("end_sec") - F.col("start_sec"), 2 * (F.col("end_frame") - F.col("start_frame"))), F.lit(0.0))
    t = clips.withColumn("_half", half).withColumn("_times", sample_times(F.col("start_sec"), F.col("end_sec"), F.col("start_frame"), F.col("end_frame"), want))
    inside = (F.col("at_sec") + F.col("_half") >= F.col("start_sec")) & (F.col("at_sec") - F.col("_half") <= F.col("end_sec"))
    bucket = 60.0
    slots = F.explode(F.sequence(F.floor((F.col("start_sec") - F.col("_half")) / bucket), F.floor((F.col("end_sec") + F.col("_half")) / bucket)))
    met = t.withColumn("_slot", slots).join(frames.withColumn("_slot", F.floor(F.col("at_sec") / bucket)), ["video_id", "_slot"]).where(inside)
    each = met.select("video_id", "shot_id", F.posexplode("_times").alias("position", "_time"), "frame", "at_sec", "_half")
    first = F.min(F.when(F.col("at_sec") + F.col("_half") >= F.col("_time"), F.struct("at_sec", "frame")))
    picked = each.groupBy("video_id", "shot_id", "position").agg(first.alias("a"), F.max(F.struct("at_sec", "frame")).alias("z"))
    return picked.select("video_id", "shot_id", "position", F.coalesce("a.frame", "z.frame").alias("frame"))
