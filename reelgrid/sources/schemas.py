"""Schemas of the entities, their keys, and checks of rows and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_LIST = T.ArrayType(_S)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


VIDEO = _schema(video_id=_S, path=_S, fps_num=_I, fps_den=_I, nb_frames=_L, duration_sec=_D, width=_I, height=_I, rotation=_I, is_vfr=_B, codec=_S)
FRAME = _schema(video_id=_S, shot_id=_I, keyframe_n=_I, original_frame_id=_L, pts_sec=_D, shot_start_sec=_D, shot_end_sec=_D, path=_S)
CLIP = _schema(video_id=_S, shot_id=_I, start_frame=_L, end_frame=_L, start_sec=_D, end_sec=_D, path=_S)
ASR_SEGMENT = _schema(video_id=_S, segment=_I, start_sec=_D, end_sec=_D, duration=_D, text_corrected=_S, speech_score=_D, asr_persons=_LIST, asr_orgs=_LIST, asr_locations=_LIST, title=_S, author=_S, channel_id=_S, watch_url=_S)
ENTITIES = {"video": VIDEO, "frame": FRAME, "clip": CLIP, "asr_segment": ASR_SEGMENT}
KEYS = {"video": ["video_id"], "frame": ["video_id", "keyframe_n"], "clip": ["video_id", "shot_id"], "asr_segment": ["video_id", "segment"]}


def require_columns(df: DataFrame, entity: str) -> DataFrame:
    """The frame itself, or an error that names the columns it lacks; more columns are fine."""
    missing = [c for c in ENTITIES[entity].names if c not in df.columns]
    if missing:
        raise ValueError(f"{entity} table lacks {', '.join(missing)}")
    return df


def invalid_rows(df: DataFrame, entity: str) -> DataFrame:
    """The rows that break a rule of their entity, with ``reason``."""
    checks = [(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in KEYS[entity]]), "null key")]
    if entity == "clip":
        checks += [(F.col("end_frame") < F.col("start_frame"), "end before start"), (F.col("start_frame") < 0, "negative frame")]
    if entity == "asr_segment":
        checks += [(F.col("end_sec") < F.col("start_sec"), "end before start"), (F.col("start_sec") < 0, "negative time")]
    if entity == "frame":
        checks += [(F.col("keyframe_n") < 1, "keyframe below 1"), (F.col("original_frame_id") < 0, "negative frame")]
    if entity == "video":
        checks += [(~F.coalesce("rotation", F.lit(0)).isin(0, 90, 180, 270), "rotation"), ((F.col("fps_num") <= 0) | (F.col("fps_den") <= 0), "rate")]
    reason = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        reason = F.when(bad, why).otherwise(reason)
    return df.withColumn("reason", reason).where("reason is not null")
