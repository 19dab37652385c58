from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import per_video, sequence

BASE = "point_id bigint, video_id string, frame_id bigint, pts_sec double, shot_id int, id bigint, v array<float>"
ASKED = "query_id bigint, event int, point_id bigint, v array<float>"


def tables(spark):
    """One video full of near points, and one that is far from every query but has all three events."""
    r = np.random.default_rng(3)
    goal = np.eye(4)[:3]
    near = [(i, "a", i, float(i), 0, i, (goal[i % 3] + 0.01 * r.normal(size=4)).tolist()) for i in range(900)]
    far = [(5000 + i, "b", 10 * i, None if i == 1 else float(i), 0, 5000 + i, (0.3 * goal[i] + [0, 0, 0, 1]).tolist()) for i in range(3)]
    asked = [(q, e, 9000 + 10 * q + e, goal[e].tolist()) for q in (1, 2) for e in range(3)] + [(3, 0, 9100, goal[0].tolist())]
    return spark.createDataFrame(asked, ASKED), spark.createDataFrame(near + far, BASE)


def every(asked, base):
    return asked.select("query_id").distinct().crossJoin(base.select("video_id").distinct())


@pytest.mark.parametrize("block_rows", [100, 5_000])
def test_a_far_video_keeps_its_slots_and_sequence(spark, block_rows):
    asked, base = tables(spark)
    videos = every(asked, base)
    slots = per_video.slots_of_videos(videos, asked, base, block_rows=block_rows)
    assert {(r.query_id, r.event, r.video_id): r["count"] for r in slots.groupBy("query_id", "event", "video_id").count().collect()} == {(q, e, v): n for q, e in [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0)] for v, n in (("a", 20), ("b", 3))}
    got = {(r.query_id, r.video_id): (round(r.score, 6), [(p.frame_id, p.pts_sec, round(p.score, 6)) for p in r.picks]) for r in per_video.sequences_of_videos(videos, asked, base, 3, block_rows=block_rows).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")} and [f for f, _, _ in got[1, "b"][1]] == [0, 10, 20]
    want = sequence.best_sequences(slots, 3).collect()
    assert got == {(r.query_id, r.video_id): (round(r.score, 6), [(p.frame_id, p.pts_sec, round(p.score, 6)) for p in r.picks]) for r in want}


def test_only_chosen_videos_are_searched(spark):
    asked, base = tables(spark)
    chosen = every(asked, base).where("query_id = 2 and video_id = 'b'")
    assert {(r.query_id, r.video_id) for r in per_video.slots_of_videos(chosen, asked, base).collect()} == {(2, "b")}


def test_own_point_is_no_hit(spark):
    _, base = tables(spark)
    asked = base.where("point_id = 5000").selectExpr("cast(1 as bigint) as query_id", "0 as event", "point_id", "v")
    assert {r.id for r in per_video.slots_of_videos(every(asked, base), asked, base).where("video_id = 'b'").collect()} == {5001, 5002}


@pytest.mark.parametrize("block_rows", [100, 5_000])
def test_videos_are_scored_over_all_points_and_shots(spark, block_rows):
    asked, base = tables(spark)
    over = asked.where("event = 0").select("query_id", F.lit(per_video.OVERVIEW).alias("event"), F.lit(None).cast("bigint").alias("point_id"), "v")
    shots = spark.createDataFrame([("b", [1.0, 0.0, 0.0, 1.0]), ("c", [0.0, 0.0, 0.0, 1.0])], "video_id string, v array<float>")
    got = {(r.query_id, r.video_id): r for r in per_video.videos_by_score(asked.unionByName(over), base, 2, 3, shots, block_rows).collect()}
    best = {(r.query_id, r.event, r.video_id): r.score for r in per_video.slots_of_videos(every(asked, base), asked, base).where("place = 1").collect()}
    assert set(got) == {(q, v) for q in (1, 2, 3) for v in "ab"}  # the third video is cut
    for (q, v), r in got.items():
        assert r.event_scores == pytest.approx([best.get((q, e, v), 0.0) for e in range(3)])
        assert r.overview_score == pytest.approx(round(0.5**0.5, 6) if v == "b" else 0)
        assert r.score == pytest.approx(r.overview_score + sum(r.event_scores) / 3)
    assert {(q, r["rank"]) for (q, _), r in got.items()} == {(q, k) for q in (1, 2, 3) for k in (1, 2)}
