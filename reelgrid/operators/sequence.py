"""Ordered event sequences inside candidate videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions.scalar import gap_penalty, within_gap

PER_VIDEO = 20
ALTERNATES = 5
GAP_WEIGHT = 0.05


def top_per_video(hits: DataFrame, n: int = PER_VIDEO) -> DataFrame:
    """The n best hits of each (query_id, event, video_id); shots are not collapsed."""
    w = W.partitionBy("query_id", "event", "video_id").orderBy(F.desc("score"), "frame_id", "id")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def candidate_videos(overview: DataFrame, events: DataFrame, n_events: DataFrame, limit: int = 100) -> DataFrame:
    """(query_id, video_id, score, overview_score, event_scores, rank): overview + mean of the events' best scores.

    ``overview``: query_id, video_id, score; ``events``: also event (0-based); ``n_events``: query_id,
    n. A video that a search doesn't name has 0 there.
    """
    o = overview.select("query_id", "video_id", F.lit(-1).alias("event"), "score")
    both = o.unionByName(events.select("query_id", "video_id", "event", "score"))
    per = both.groupBy("query_id", "video_id").agg(F.coalesce(F.max(F.when(F.col("event") < 0, F.col("score"))), F.lit(0.0)).alias("overview_score"), F.map_from_entries(F.collect_list(F.when(F.col("event") >= 0, F.struct("event", "score")))).alias("m"))
    scores = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda e: F.coalesce(F.element_at("m", e), F.lit(0.0)))
    per = per.join(n_events, "query_id").withColumn("event_scores", scores)
    per = per.withColumn("score", F.col("overview_score") + F.aggregate("event_scores", F.lit(0.0), lambda a, x: a + x) / F.col("n")).drop("m", "n")
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "video_id")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def best_sequences(slots: DataFrame, n_events: int, max_gap: float = 300.0, gap_weight: float = GAP_WEIGHT) -> DataFrame:
    """(query_id, video_id, score, picks): one candidate per event with strictly rising frames, exactly.

    Maximises mean(score) - gap_weight x mean(gap penalty). ``slots``: query_id, video_id, event,
    frame_id, pts_sec, shot_id, score, at most a few per event. Videos without a candidate for every
    event, or without a valid order, give no row. An unknown time costs nothing and is no gap. Ties:
    the smaller predecessor frame, at the end the smaller last frame.

    The events are folded one by one: a state is the best chain that ends at a candidate, so each step
    joins at most (candidates x candidates) rows of one (query, video), on a key both sides already share.
    """
    weight = gap_weight * n_events / (n_events - 1) if n_events > 1 else 0.0
    pick = F.struct("frame_id", "shot_id", "pts_sec", "score")
    slots = slots.repartition("query_id", "video_id")

    def of(e: int) -> DataFrame:
        return slots.where(F.col("event") == e).select("query_id", "video_id", pick.alias("pick"))

    state = of(0).select("query_id", "video_id", F.col("pick.score").alias("total"), F.col("pick").alias("last"), F.array("pick").alias("chain"))
    for e in range(1, n_events):
        gap = F.col("pick.pts_sec") - F.col("last.pts_sec")
        step = state.join(of(e), ["query_id", "video_id"]).where((F.col("last.frame_id") < F.col("pick.frame_id")) & within_gap(gap, max_gap))
        step = step.withColumn("worth", F.col("total") - weight * gap_penalty(gap))
        best = F.min_by(F.struct("worth", "chain"), F.struct((-F.round("worth", 12)).alias("w"), F.col("last.frame_id").alias("f")))
        state = step.groupBy("query_id", "video_id", "pick").agg(best.alias("b")).select("query_id", "video_id", (F.col("b.worth") + F.col("pick.score")).alias("total"), F.col("pick").alias("last"), F.concat("b.chain", F.array("pick")).alias("chain"))
    end = state.groupBy("query_id", "video_id").agg(F.min_by(F.struct("total", "chain"), F.struct((-F.round("total", 12)).alias("w"), F.col("last.frame_id").alias("f"))).alias("b"))
    return end.select("query_id", "video_id", (F.col("b.total") / n_events).alias("score"), F.col("b.chain").alias("picks"))


def alternates(slots: DataFrame, sequences: DataFrame, max_gap: float = 300.0, gap_weight: float = GAP_WEIGHT, n: int = ALTERNATES) -> DataFrame:
    """(query_id, video_id, event, place, frame_id, score): other candidates that keep the sequence valid, best first.

    Ranked by score - gap_weight x the penalties towards both neighbours; by score if the weight is 0.
    """
    p = sequences.select("query_id", "video_id", F.posexplode("picks").alias("event", "chosen"), "picks")
    p = p.withColumn("before", F.when(F.col("event") > 0, F.try_element_at("picks", F.col("event")))).withColumn("after", F.try_element_at("picks", F.col("event") + 2)).drop("picks")
    c = slots.select("query_id", "video_id", "event", "frame_id", "pts_sec", "score").join(p, ["query_id", "video_id", "event"])
    g1, g2 = F.col("pts_sec") - F.col("before.pts_sec"), F.col("after.pts_sec") - F.col("pts_sec")
    ok1 = F.col("before").isNull() | ((F.col("before.frame_id") < F.col("frame_id")) & within_gap(g1, max_gap))
    ok2 = F.col("after").isNull() | ((F.col("frame_id") < F.col("after.frame_id")) & within_gap(g2, max_gap))
    c = c.where((F.col("frame_id") != F.col("chosen.frame_id")) & ok1 & ok2)
    worth = F.col("score") - (gap_weight * (gap_penalty(g1) + gap_penalty(g2)) if gap_weight > 0 else 0.0)
    w = W.partitionBy("query_id", "video_id", "event").orderBy(F.desc(F.round("worth", 9)), "frame_id")
    return c.withColumn("worth", worth).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "video_id", "event", "place", "frame_id", "score")


def neighbours(frames: DataFrame, radius: int, chosen: DataFrame | None = None, bucket: int = 5_000) -> DataFrame:
    """The keyframes up to ``radius`` places before and after each one (or each ``chosen`` one), itself too, with is_same_shot.

    ``frames``: video_id, keyframe_n, shot_id, original_frame_id; out: chosen_n, keyframe_n and the
    other columns. Frames are numbered bucket by bucket of ``bucket`` frame numbers, so that no video is
    in one task, and meet by their places.
    """
    at = frames.withColumn("_b", F.floor(F.col("original_frame_id") / bucket))
    sizes = at.groupBy("video_id", "_b").agg(F.count("*").alias("_n"))
    # One row per (video, bucket).
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("video_id").orderBy("_b")) - F.col("_n")).drop("_n")
    inside = at.withColumn("_in", F.row_number().over(W.partitionBy("video_id", "_b").orderBy("original_frame_id", "keyframe_n")))
    numbered = inside.join(before, ["video_id", "_b"]).withColumn("_pos", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")
    own = numbered if chosen is None else numbered.join(chosen, ["video_id", "keyframe_n"], "left_semi")
    c = own.select("video_id", F.col("keyframe_n").alias("chosen_n"), F.col("shot_id").alias("chosen_shot"), F.explode(F.sequence(F.col("_pos") - radius, F.col("_pos") + radius)).alias("_pos"))
    return c.join(numbered, ["video_id", "_pos"]).withColumn("is_same_shot", F.col("shot_id") == F.col("chosen_shot")).drop("_pos", "chosen_shot")


def pair_scores(hits: DataFrame, max_gap: float = 300.0, top: int = 10, pair_weight: float = 10.0, mean_weight: float = 5.0) -> DataFrame:
    """(query_id, video_id, score): of two events in a video, ``pair_weight`` x the best ordered pair + ``mean_weight`` x both events' mean of their ``top`` hits.

    ``hits``: query_id, event (0 or 1), video_id, frame_id, id, pts_sec, score. The second event comes
    after the first by at most ``max_gap`` seconds; a video without such a pair has 0 for it.
    """
    best = top_per_video(hits, top)
    means = best.groupBy("query_id", "video_id").agg(*[F.coalesce(F.avg(F.when(F.col("event") == e, F.col("score"))), F.lit(0.0)).alias(f"m{e}") for e in (0, 1)])
    side = lambda e: best.where(F.col("event") == e).select("query_id", "video_id", F.col("pts_sec").alias(f"t{e}"), F.col("score").alias(f"s{e}"))
    gap = F.col("t1") - F.col("t0")
    pairs = side(0).join(side(1), ["query_id", "video_id"]).where((gap > 0) & (gap <= max_gap)).groupBy("query_id", "video_id").agg(F.max(F.col("s0") + F.col("s1")).alias("pair"))
    joined = means.join(pairs, ["query_id", "video_id"], "left")
    return joined.select("query_id", "video_id", (pair_weight * F.coalesce("pair", F.lit(0.0)) + mean_weight * (F.col("m0") + F.col("m1"))).alias("score"))


def rescored_by_neighbours(current: DataFrame, previous: DataFrame, following: DataFrame) -> DataFrame:
    """The current part's hits with the best score that the parts before and after reach in the same video added; 0 where they reach none."""
    best = lambda h, c: h.groupBy("query_id", "video_id").agg(F.max("score").alias(c))
    joined = current.join(best(previous, "_p"), ["query_id", "video_id"], "left").join(best(following, "_f"), ["query_id", "video_id"], "left")
    return joined.withColumn("score", F.col("score") + F.coalesce("_p", F.lit(0.0)) + F.coalesce("_f", F.lit(0.0))).drop("_p", "_f")
