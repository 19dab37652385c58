"""Retrieval evaluation, and the building of evaluation questions from transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions.text import tokenize
from reelgrid.operators.temporal import nearest_shot

RANKS = (1, 5, 20, 50, 100)
LAST_RANK = 100
LEAST_DF = 3
TOP_TOKENS = 8
ENTITY_WEIGHT = 2.0
WINDOW = 32


def rank_of(hits: DataFrame, answers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank): the first rank up to 100 whose (video_id, shot_id) is an answer, else null."""
    found = hits.where(F.col("rank") <= LAST_RANK).join(answers.select("query_id", "video_id", "shot_id").distinct(), ["query_id", "video_id", "shot_id"], "left_semi")
    return queries.select("query_id").distinct().join(found.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def summarise(ranks: DataFrame) -> DataFrame:
    """One row: queries, found, recall at 1, 5, 20, 50 and 100, their mean, and the mean reciprocal rank; zeros when empty."""
    at = [F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_at_{k}") for k in RANKS]
    out = ranks.agg(F.count("*").alias("queries"), F.count("rank").alias("found"), *at, F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))
    return out.withColumn("mean_recall", sum((F.col(f"recall_at_{k}") for k in RANKS), F.lit(0.0)) / len(RANKS))


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """(token, df): in how many rows each token appears; rows count as often as they occur."""
    return docs.select(F.explode(F.array_distinct(tokenize(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def rarity(df: DataFrame, total: Column, least: int = LEAST_DF) -> DataFrame:
    """(token, idf): ln(N / (1 + df)) of tokens that appear in at least ``least`` rows."""
    return df.where(F.col("df") >= least).select("token", F.log(total / (1 + F.col("df"))).alias("idf"))


def distinctiveness(docs: DataFrame, keys: list[str], text: str, entities: str, idf: DataFrame, top: int = TOP_TOKENS) -> DataFrame:
    """(keys, distinctiveness): the sum of the ``top`` largest idf of a row's tokens; those of its entities count double."""
    named = F.flatten(F.transform(F.coalesce(F.col(entities), F.array().cast("array<string>")), lambda e: tokenize(e)))
    t = docs.select(*keys, F.explode(F.array_distinct(tokenize(F.col(text)))).alias("token"), named.alias("named"))
    t = t.join(idf, "token").select(*keys, (F.col("idf") * F.when(F.array_contains("named", F.col("token")), ENTITY_WEIGHT).otherwise(1.0)).alias("s"))
    best = t.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, top).alias("b"))
    return best.select(*keys, F.aggregate("b", F.lit(0.0), lambda a, x: a + x).alias("distinctiveness"))


def best_window(docs: DataFrame, keys: list[str], text: str, idf: DataFrame, words: int = WINDOW) -> DataFrame:
    """(keys, best_text): the run of ``words`` words of the largest idf sum, the first of equal ones; short texts stay whole.

    Sums run over the words of one text; the words themselves are cut from the text once the place is known.
    """
    d = docs.select(*keys, F.col(text).alias("_text"), F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ").alias("_words"))
    long = d.where(F.size("_words") > words)
    w = long.select(*keys, F.size("_words").alias("n"), F.posexplode("_words").alias("p", "word"))
    terms = w.select(*keys, "n", "p", F.explode_outer(F.array_distinct(tokenize(F.col("word")))).alias("token")).join(idf, "token", "left")
    scored = terms.groupBy(*keys, "n", "p").agg(F.coalesce(F.sum("idf"), F.lit(0.0)).alias("s"))
    run = W.partitionBy(*keys).orderBy("p").rowsBetween(0, words - 1)
    r = scored.withColumn("total", F.round(F.sum("s").over(run), 9)).where(F.col("p") + words <= F.col("n"))
    best = r.groupBy(*keys).agg(F.min_by("p", F.struct((-F.col("total")).alias("t"), "p")).alias("_p"))
    cut = long.join(best, keys).select(*keys, F.array_join(F.slice("_words", F.col("_p") + 1, F.lit(words)), " ").alias("best_text"))
    return d.where(F.size("_words") <= words).select(*keys, F.col("_text").alias("best_text")).unionByName(cut)


def one_per_question(candidates: DataFrame, per_video: int = 3, limit: int = 300) -> DataFrame:
    """Questions whose text occurs in one video only, at most ``per_video`` each, the most distinctive first.

    ``candidates``: best_text, video_id, shot_id, distinctiveness, start_sec, frames. Out: the question with its
    answers, shots and frames; the limit is the size of the evaluation set that is asked for.
    """
    g = candidates.groupBy("best_text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("frames")))).alias("answer_frames"), F.countDistinct("video_id").alias("videos"), F.min("video_id").alias("video_id"), F.max("distinctiveness").alias("distinctiveness"), F.sort_array(F.collect_set("shot_id")).alias("answers"), F.min("start_sec").alias("start_sec")).where("videos = 1").drop("videos")
    order = [F.desc(F.round("distinctiveness", 6)), F.col("best_text")]
    g = g.withColumn("_r", F.row_number().over(W.partitionBy("video_id").orderBy(*order))).where(F.col("_r") <= per_video).drop("_r")
    return g.orderBy(*order).limit(limit)


LEAST_TOKENS = 6
MOST_KEYFRAMES = 30


def shot_frames(frames: DataFrame) -> DataFrame:
    """(video_id, shot_id, frames): the frame numbers of each shot's keyframes in order."""
    return frames.groupBy("video_id", "shot_id").agg(F.sort_array(F.collect_list("original_frame_id")).alias("frames"))


def askable(candidates: DataFrame, frames: DataFrame, text: str, least_tokens: int = LEAST_TOKENS, most_keyframes: int = MOST_KEYFRAMES) -> DataFrame:
    """The shots a question can be made of, with their ``frames``: enough words, and some keyframes but not too many.

    A shot without a keyframe can never be found, one with very many is found by chance.
    """
    n = frames.groupBy("video_id", "shot_id").agg(F.count("original_frame_id").alias("_n")).where((F.col("_n") > 0) & (F.col("_n") <= most_keyframes)).drop("_n")
    few = shot_frames(frames.where("original_frame_id is not null").join(n, ["video_id", "shot_id"], "left_semi"))
    return candidates.where(F.size(tokenize(F.col(text))) >= least_tokens).join(few, ["video_id", "shot_id"])


def remap_answers(answers: DataFrame, frame_times: DataFrame, shots: DataFrame) -> DataFrame:
    """(query_id, answer_shot_ids, lost): answer frames moved to another shot list by their times.

    ``answers``: query_id, video_id, answer_frame_ids; ``frame_times``: video_id, frame_id, pts_sec.
    Frames without a time and videos without shots are lost, and counted.
    """
    a = answers.select("query_id", "video_id", F.explode_outer("answer_frame_ids").alias("frame_id"))
    t = a.join(frame_times.groupBy("video_id", "frame_id").agg(F.min("pts_sec").alias("pts_sec")), ["video_id", "frame_id"], "left")
    found = nearest_shot(t, shots, "pts_sec")
    return found.groupBy("query_id").agg(F.sort_array(F.collect_set("found_shot")).alias("answer_shot_ids"), F.sum(F.col("found_shot").isNull().cast("int")).alias("lost"))


def ndcg(hits: DataFrame, gains: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, ndcg): discounted gain of the first ``k`` hits over the best possible; 0 without answers.

    ``gains``: query_id, video_id, shot_id, gain.
    """
    got = hits.where(F.col("rank") <= k).join(gains, ["query_id", "video_id", "shot_id"]).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = gains.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gain")))).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias("ideal"))
    out = queries.select("query_id").distinct().join(best, "query_id", "left").join(got, "query_id", "left")
    return out.select("query_id", F.coalesce(F.try_divide(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")), F.lit(0.0)).alias("ndcg"))
