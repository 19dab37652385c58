"""Shots from score series, and where keyframes are taken in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.operators.temporal import shot_of_frame

TRANSITION = 0.5
CUT = 27.0
SHORTEST = 15


def scenes_from_scores(scores: DataFrame, threshold: float = TRANSITION) -> DataFrame:
    """(video_id, start_frame, end_frame): a shot ends on the first frame of each flagged run, except frame 0.

    ``scores``: video_id, frame (0-based without holes), score; flagged means strictly above the threshold.
    """
    w = W.partitionBy("video_id").orderBy("frame")
    flagged = F.col("score") > threshold
    f = scores.withColumn("_on", F.coalesce(flagged, F.lit(False))).withColumn("_before", F.lag("_on", 1, False).over(w))
    ends = f.where("_on and not _before and frame <> 0").select("video_id", "frame")
    last = scores.groupBy("video_id").agg(F.max("frame").alias("frame"))
    closes = ends.union(last).distinct()
    return closes.select("video_id", (F.lag("frame", 1, -1).over(w) + 1).alias("start_frame"), F.col("frame").alias("end_frame")).where("start_frame <= end_frame")


def merge_short_scenes(scenes: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Short scenes run on from the one before; a short opening one takes in the next."""
    w = W.partitionBy("video_id").orderBy("start_frame")
    long = (F.col("end_frame") - F.col("start_frame") + 1) >= shortest
    g = scenes.withColumn("_g", F.sum(F.when(long | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))
    m = g.groupBy("video_id", "_g").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
    opens_short = F.first(F.col("end_frame") - F.col("start_frame") + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) < shortest
    m = m.withColumn("_h", F.when((F.col("_g") == 2) & opens_short, 1).otherwise(F.col("_g")))
    return m.groupBy("video_id", "_h").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("_h")


def find_cuts(scores: DataFrame, threshold: float = CUT, shortest: int = SHORTEST) -> DataFrame:
    """(video_id, frame): frames that start a shot: at or above the threshold and far enough from the last accepted cut.

    The rule looks back at what it accepted, but a candidate that follows the one before by the
    shortest length is accepted whatever happened before. So candidates fall into independent runs, and
    only a run is folded; no video is ever in one array.
    """
    w = W.partitionBy("video_id").orderBy("frame")
    c = scores.where(F.col("score") >= threshold).withColumn("_gap", F.col("frame") - F.lag("frame", 1, 0).over(w))
    c = c.withColumn("_run", F.sum(F.when(F.col("_gap") >= shortest, 1).otherwise(0)).over(w))
    runs = c.groupBy("video_id", "_run").agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    start = F.struct(F.when(F.col("_run") == 0, F.lit(0)).otherwise(F.col("frames")[0] - shortest).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        ok = x - s["last"] >= shortest
        return F.struct(F.when(ok, x).otherwise(s["last"]).alias("last"), F.when(ok, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    folded = runs.withColumn("r", F.aggregate(F.transform("frames", lambda x: x.cast("bigint")), start, step))
    return folded.select("video_id", F.explode("r.kept").alias("frame"))


def plan_targets(start: Column, end: Column, fps: Column, per_second: float = 1.0, inset: float = 0.1, per_shot: int | None = None) -> Column:
    """Evenly spaced frames inside a shot, away from its edges: an ARRAY<BIGINT>, rising and without repeats."""
    length = end - start + 1
    off = F.floor(length * inset)
    low, high = start + off, end - off
    middle = F.floor((start + end) / 2)
    lo, hi = F.when(high < low, middle).otherwise(low), F.when(high < low, middle).otherwise(high)
    want = F.lit(max(1, per_shot)) if per_shot is not None else F.greatest(F.lit(1), F.bround(F.try_divide(length, fps) * per_second))
    span = hi - lo + 1
    count = F.least(want, span).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda p: lo + F.floor((p + 0.5) * span / count)))


def plan_windows(start: Column, end: Column, targets: Column, reach: int = 2) -> Column:
    """Windows of ``reach`` frames around each target that never overlap: ARRAY<STRUCT<target, low, high>>.

    Each begins after the furthest end of those before, which is all that the ones before decide.
    """

    start, end = start.cast("bigint"), end.cast("bigint")

    def step(s: Column, t: Column) -> Column:
        low, high = F.greatest(start, t - reach, s["end"] + 1), F.least(end, t + reach)
        made = F.struct(t.alias("target"), low.alias("low"), high.alias("high"))
        return F.struct(F.greatest(s["end"], high).alias("end"), F.when(high >= low, F.concat(s["kept"], F.array(made))).otherwise(s["kept"]).alias("kept"))

    zero = F.struct((start - 1).alias("end"), F.array().cast("array<struct<target:bigint,low:bigint,high:bigint>>").alias("kept"))
    return F.aggregate(targets, zero, step)["kept"]


def check_shots(shots: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, shots, reversed, overlaps, keyframes, outside, tail_gap, missing_shots, only_in): what doesn't fit between shots and keyframes.

    ``reversed``: shots that end before they start; ``overlaps``: shots that reach into the next one;
    ``outside``: keyframes in no shot; ``tail_gap``: frames from the last shot's end to the last
    keyframe, if any; ``missing_shots``: keyframes that name a shot which isn't there.
    ``shots``: video_id, shot_id, start_frame, end_frame; ``frames``: video_id, shot_id, original_frame_id.
    """
    w = W.partitionBy("video_id").orderBy("start_frame", "shot_id")
    s = shots.withColumn("_next", F.lead("start_frame").over(w)).groupBy("video_id").agg(F.count("*").alias("shots"), F.count_if(F.col("end_frame") < F.col("start_frame")).alias("reversed"), F.count_if(F.col("_next") <= F.col("end_frame")).alias("overlaps"), F.max("end_frame").alias("_end"))
    placed = shot_of_frame(frames.where("original_frame_id is not null"), shots, "original_frame_id", "strict")
    f = frames.groupBy("video_id").agg(F.count("*").alias("keyframes"), F.max("original_frame_id").alias("_last"))
    out_of = placed.groupBy("video_id").agg(F.count_if(F.col("found_shot").isNull()).alias("outside"))
    lost = frames.where("shot_id is not null").join(shots.select("video_id", "shot_id"), ["video_id", "shot_id"], "left_anti").groupBy("video_id").agg(F.count("*").alias("missing_shots"))
    out = s.join(f, "video_id", "full_outer").join(out_of, "video_id", "left").join(lost, "video_id", "left").withColumn("tail_gap", F.greatest(F.col("_last") - F.col("_end"), F.lit(0)))
    only = F.when(F.col("shots").isNull(), "frames").when(F.col("keyframes").isNull(), "shots").otherwise("both")
    return out.select("video_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shots", "reversed", "overlaps", "keyframes", "outside", "tail_gap", "missing_shots")], only.alias("only_in"))


def sharpest_frames(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, shot_id, target, frame, sharpness): the sharpest scored frame of each window, of equal ones the first.

    ``windows``: video_id, shot_id, target, low, high; ``frames``: video_id, frame, sharpness.
    """
    w = windows.withColumn("frame", F.explode(F.sequence("low", "high")))
    best = F.max_by(F.struct("frame", "sharpness"), F.struct("sharpness", (-F.col("frame")).alias("f")))
    hit = w.join(frames, ["video_id", "frame"]).groupBy("video_id", "shot_id", "target").agg(best.alias("b"))
    return hit.select("video_id", "shot_id", "target", "b.frame", "b.sharpness")


#: Of each detector the way from scores to shots, and its threshold.
DETECTORS = {"transition": TRANSITION, "content": CUT}


def detect_shots(scores: DataFrame, rates: DataFrame, detector: str = "transition", threshold: float | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(video_id, shot_id, start_frame, end_frame, start_sec, end_sec, path): the clip rows of every video from its score series.

    ``scores``: video_id, frame, score; ``rates``: video_id, fps_num, fps_den, path. The detector
    'transition' flags runs above the threshold, 'content' cuts where frames differ; short shots are
    merged. Shots are numbered from 0, and end_sec is the time of the last frame.
    """
    if detector not in DETECTORS:
        raise ValueError(f"no detector {detector}; there are {', '.join(DETECTORS)}")
    level = DETECTORS[detector] if threshold is None else threshold
    w = W.partitionBy("video_id").orderBy("start_frame")
    if detector == "transition":
        ranges = merge_short_scenes(scenes_from_scores(scores, level), shortest)
    else:
        starts = find_cuts(scores, level, shortest).union(scores.select("video_id", F.lit(0).cast("bigint")).distinct()).toDF("video_id", "start_frame").distinct()
        last = scores.groupBy("video_id").agg(F.max("frame").alias("_last"))
        ranges = starts.join(last, "video_id").withColumn("end_frame", F.coalesce(F.lead("start_frame").over(w) - 1, F.col("_last"))).drop("_last")
    sec = lambda c: F.col(c) * F.col("fps_den") / F.col("fps_num")
    numbered = ranges.withColumn("shot_id", F.row_number().over(w) - 1).join(rates, "video_id")
    return numbered.select("video_id", "shot_id", "start_frame", "end_frame", sec("start_frame").alias("start_sec"), sec("end_frame").alias("end_sec"), "path")
