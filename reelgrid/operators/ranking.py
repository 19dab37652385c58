"""Dedupe, normalisation, fusion and reranking of hits, for many queries at once.

A hit row has query_id, score, video_id, shot_id and a unique ``id``; other columns are carried.
Of equal scores the smaller (video_id, shot_id, id) comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
SECOND_WEIGHT = 0.05
CLIP_WEIGHT = 0.5
HEAD = 30


def _order() -> list[Column]:
    return [F.desc("score"), F.col("video_id"), F.col("shot_id"), F.col("id")]


def best_per(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The best hit of each key, combined before the shuffle: an aggregation, no window."""
    rest = [c for c in hits.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("score")).alias("s"), "video_id", "shot_id", "id"))
    return hits.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col("b").getField(c).alias(c) for c in rest])


def dedupe_by_shot(hits: DataFrame, k: int | None = None) -> DataFrame:
    out = best_per(hits, ["query_id", "video_id", "shot_id"])
    return ranked(out, k)


def dedupe_by_video(hits: DataFrame, k: int | None = None) -> DataFrame:
    return ranked(best_per(hits, ["query_id", "video_id"]), k)


def ranked(hits: DataFrame, k: int | None = None, rank: str = "rank") -> DataFrame:
    """Numbered 1..n per query; rows beyond ``k`` go."""
    out = hits.withColumn(rank, F.row_number().over(W.partitionBy("query_id").orderBy(*_order())))
    return out if k is None else out.where(F.col(rank) <= k)


def video_scores(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "video_id").agg(F.max("score").alias("score"))


def normalize(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Min-max to 0..1 within ``by``; where all scores are equal, 1. The hits are read once: a window over a hit list, no join with its own aggregate."""
    w = W.partitionBy(*(by or ["query_id"]))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("_lo", low).withColumn("_hi", high).withColumn("score", F.when(F.col("_hi") <= F.col("_lo"), 1.0).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


SHOT = ["query_id", "video_id", "shot_id"]


def _carried(first: DataFrame, second: DataFrame) -> list[str]:
    """The columns that both lists carry besides the key of the shot and the score."""
    return [c for c in first.columns if c in second.columns and c not in (*SHOT, "score", "rank")]


def _pass_through(primary: DataFrame, second: DataFrame, carried: list[str]) -> DataFrame:
    """The primary rows of queries for which the second list is empty: uncollapsed, with their own scores."""
    return primary.join(second.select("query_id").distinct(), "query_id", "left_anti").select(*SHOT, "score", *carried)


def fuse_frames_and_clips(frames: DataFrame, clips: DataFrame, weight: float = CLIP_WEIGHT) -> DataFrame:
    """(query_id, video_id, shot_id, score, what both carry): frame score + weight x clip score of each shot.

    Both lists are collapsed to their best per shot; a shot that one list lacks gets that list's
    smallest collapsed score. The frame's row is carried, where there is none the clip's. A query
    without clips, or a weight of 0, keeps all its frames with their own scores.
    """
    carried = _carried(frames, clips)
    if weight <= 0:
        return frames.select(*SHOT, "score", *carried)
    f = best_per(frames, SHOT).select(*SHOT, F.col("score").alias("f"), F.struct(*carried).alias("fr")) if carried else best_per(frames, SHOT).select(*SHOT, F.col("score").alias("f"))
    c = best_per(clips, SHOT).select(*SHOT, F.col("score").alias("c"), F.struct(*carried).alias("cr")) if carried else best_per(clips, SHOT).select(*SHOT, F.col("score").alias("c"))
    query = W.partitionBy("query_id")
    both = f.join(c, SHOT, "full_outer").withColumn("fm", F.min("f").over(query)).withColumn("cm", F.min("c").over(query))
    row = F.when(F.col("f").isNotNull(), F.col("fr")).otherwise(F.col("cr")) if carried else None
    fused = both.where("cm is not null").select(*SHOT, (F.coalesce("f", "fm", F.lit(0.0)) + weight * F.coalesce("c", "cm")).alias("score"), *[row[x].alias(x) for x in carried])
    return fused.unionByName(_pass_through(frames, clips, carried))


def rrf_two(primary: DataFrame, second: DataFrame, weight: float = SECOND_WEIGHT, k: int = RRF_K) -> DataFrame:
    """Reciprocal ranks of two lists collapsed per shot: 1/(k + r1) + weight/(k + r2), with what both carry.

    The primary row is carried, with the second one's ocr_text where it has none; where there is no
    primary row, the second. A query whose second list is empty, or a weight of 0, keeps the primary
    rows as they are.
    """
    carried = _carried(primary, second)
    if weight <= 0:
        return primary.select(*SHOT, "score", *carried)
    row = F.struct(F.lit(1).alias("_"), *carried)
    a = dedupe_by_shot(primary).select(*SHOT, F.col("rank").alias("r1"), row.alias("a"))
    b = dedupe_by_shot(second).select(*SHOT, F.col("rank").alias("r2"), row.alias("b"))
    score = F.coalesce(1 / (k + F.col("r1")), F.lit(0.0)) + F.coalesce(weight / (k + F.col("r2")), F.lit(0.0))
    pick = [(F.coalesce("a.ocr_text", "b.ocr_text") if c == "ocr_text" else F.when(F.col("r1").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))).alias(c) for c in carried]
    both = a.join(b, SHOT, "full_outer").withColumn("_some", F.max("r2").over(W.partitionBy("query_id"))).where("_some is not null")
    return both.select(*SHOT, score.alias("score"), *pick).unionByName(_pass_through(primary, second, carried))


def rrf_many(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score): the sum of 1/(k + rank) over the lists a point is in; each list has ``rank``."""
    parts = [x.select("query_id", "id", (1 / (k + F.col("rank"))).alias("part")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def weighted_fusion(branches: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """(keys, score): each branch min-max normalised per query, then the weighted sum; a branch of weight 0 is skipped."""
    parts = [normalize(df).select(*keys, (F.col("score") * w).alias("part")) for df, w in branches if w > 0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("part").alias("score"))


def speech_bonus(frames: DataFrame, segments: DataFrame, weight: float = 0.3, pad: float = 1.0, bucket: float = 30.0) -> DataFrame:
    """Adds weight x the best normalised score of the segments that overlap the frame's window, ends included.

    ``frames`` carries low and high (the window without pad, may be null), ``segments`` query_id,
    video_id, start_sec, end_sec, score. Windows are cut into time buckets that both sides share, so
    that one long video is spread and no frame meets all its segments.
    """
    s = normalize(segments)
    low, high = F.col("low") - pad, F.col("high") + pad
    slots = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    # Frames of one window, and segments of one span, overlap the same: each window meets each span once.
    window = ["query_id", "video_id", "lo", "hi"]
    f = frames.where("low is not null and high >= low").select("query_id", "video_id", "id", low.alias("lo"), high.alias("hi"))
    g = s.where("end_sec >= start_sec").groupBy("query_id", "video_id", "start_sec", "end_sec").agg(F.max("score").alias("speech"))
    met = f.select(*window).distinct().withColumn("slot", slots(F.col("lo"), F.col("hi"))).join(g.withColumn("slot", slots(F.col("start_sec"), F.col("end_sec"))), ["query_id", "video_id", "slot"])
    bonus = met.where("start_sec <= hi and end_sec >= lo").groupBy(*window).agg(F.max("speech").alias("bonus"))
    best = f.join(bonus, window).groupBy("query_id", "id").agg(F.max("bonus").alias("bonus"))
    out = frames.join(best, ["query_id", "id"], "left")
    return out.withColumn("score", F.col("score") + weight * F.coalesce("bonus", F.lit(0.0))).drop("bonus")


def rerank_head(hits: DataFrame, new_score: Column, top_n: int = HEAD) -> DataFrame:
    """The first ``top_n`` ranks get a new score and order; the rest stay below them. A head of one stays as it is.

    ``hits`` carries ``rank``; out: block (0 the head), score and the new rank.
    """
    size = hits.groupBy("query_id").agg(F.count("*").alias("_n"))
    h = hits.join(size, "query_id").withColumn("block", F.when(F.col("rank") <= top_n, 0).otherwise(1))
    h = h.withColumn("score", F.when((F.col("block") == 0) & (F.least(F.col("_n"), F.lit(top_n)) >= 2), new_score).otherwise(F.col("score"))).drop("_n")
    order = W.partitionBy("query_id").orderBy("block", F.when(F.col("block") == 0, -F.col("score")), "rank")
    return h.withColumn("new_rank", F.row_number().over(order))
