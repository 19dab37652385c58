from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.functions import models, scalar
from reelgrid.operators import shots


def test_embedder(spark):
    e = models.embedder(lambda: 2.0, lambda m, xs: np.array([[len(x), m, 0] for x in xs]), 3, batch=2)
    got = [r.v for r in spark.createDataFrame([("abc",), (None,), ("",)], "t string").select(e("t").alias("v")).collect()]
    assert got[0] == pytest.approx(np.array([3, 2, 0]) / 13**0.5) and got[1] is None and got[2] == pytest.approx(np.array([1, 2, 0]) / 5**0.5)


def test_bad_vectors():
    for x in ([[0, 0]], [[1, float("nan")]], [[1, 2, 3]]):
        with pytest.raises(ValueError):
            models.normalized(np.array(x), 2)


def test_sparse_encoder(spark):
    e = models.sparse_encoder(lambda: None, lambda m, xs: np.array([[-1.0, 0.0, len(x)] for x in xs]))
    got = [r.v for r in spark.createDataFrame([("ab",), (None,), ("",)], "t string").select(e("t").alias("v")).collect()]
    assert got == [{2: 1.0986}, None, {}]


def test_pictures():
    flat, edge = np.full((5, 5), 9), np.zeros((5, 5))
    edge[2, 2] = 100
    assert models.sharpness(flat) == 0 < models.sharpness(edge)
    assert models.mean_difference(np.zeros((2, 2), np.uint8), np.full((2, 2), 250, np.uint8)) == 250


def test_sharpest_takes_the_first_of_equal_ones(spark):
    w = spark.createDataFrame([("v", 1, 5, 3, 7)], "video_id string, shot_id int, target bigint, low bigint, high bigint")
    f = spark.createDataFrame([("v", 3, 1.0), ("v", 4, 2.0), ("v", 6, 2.0), ("v", 9, 9.0)], "video_id string, frame bigint, sharpness double")
    assert [(r.frame, r.sharpness) for r in shots.sharpest_frames(w, f).collect()] == [(4, 2.0)]


def test_feedback(spark):
    q = F.array(F.lit(1.0), F.lit(0.0))
    v = spark.range(1).select(scalar.feedback_vector(q, F.array(F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(2.0))), F.lit(None).cast("array<array<double>>")).alias("v")).first().v
    assert v == pytest.approx([1.75, 1.5])


def test_profiles():
    p = models.register_profile(models.Profile("test-image", "m", 8, "image"))
    assert models.register_profile(p) is p and models.profile("test-image", "image") == p
    with pytest.raises(ValueError, match="another"):
        models.register_profile(models.Profile("test-image", "m", 9, "image"))
    with pytest.raises(ValueError, match="for image"):
        models.profile("test-image", "text")
    with pytest.raises(ValueError, match="no profile"):
        models.profile("none")


def test_pair_scorer_and_rewriter(spark):
    score = models.pair_scorer(lambda: 2, lambda m, a, b: [m * len(x) + len(y) for x, y in zip(a, b)], batch=1)
    df = spark.createDataFrame([("ab", "c"), (None, "c"), ("a", None)], "a string, b string")
    assert [r.s for r in df.select(score("a", "b").alias("s")).collect()] == [5.0, None, None]
    better = models.text_rewriter(lambda: None, lambda m, xs: [None if x == "ab" else x.upper() for x in xs])
    assert [r.s for r in df.select(better("a").alias("s")).collect()] == ["ab", None, "A"]

    def fails(m, xs):
        raise OSError

    assert [r.s for r in df.select(models.text_rewriter(lambda: None, fails)("a").alias("s")).collect()] == ["ab", None, "a"]


def test_differences_by_video(spark):
    rows = [("v", i, bytes([10 * i, 0])) for i in (2, 0, 1)] + [("w", 0, bytes([5, 5]))]
    df = spark.createDataFrame(rows, "video_id string, frame int, p binary")
    got = {(r.video_id, r.frame): r.score for r in models.by_video(df, models.differences, "p").collect()}
    assert got == {("v", 0): 0.0, ("v", 1): 5.0, ("v", 2): 5.0, ("w", 0): 0.0}
