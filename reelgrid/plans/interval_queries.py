"""Problem 4: continuous periods and gaps of speech segments and clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators.intervals import periods_and_gaps
from reelgrid.session import table

LONGEST_GAP_MS = 600_000
LONGEST_GAP_FRAMES = 15_000


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of asr_segments (milliseconds) and clips (frames), in one pass over both."""
    ms = lambda c: F.when(~F.isnan(c), F.round(F.col(c) * 1000)).cast("bigint")
    speech = table(spark, sf_dir, "asr_segments").select(F.lit("asr").alias("origin"), "video_id", ms("start_sec").alias("a"), ms("end_sec").alias("b"))
    # Frames are inclusive: one is added, so that ranges that follow directly touch. It is taken off below.
    clips = table(spark, sf_dir, "clips").where("end_frame >= start_frame").select(F.lit("clip").alias("origin"), "video_id", F.col("start_frame").alias("a"), (F.col("end_frame") + 1).alias("b"))
    spans = periods_and_gaps(speech.unionByName(clips), ["origin", "video_id"], F.col("a"), F.col("b"))
    length = F.col("span_end") - F.col("span_start")
    kept = (F.col("span_kind") == "period") | (length <= F.when(F.col("origin") == "asr", LONGEST_GAP_MS).otherwise(LONGEST_GAP_FRAMES))
    last = F.col("span_end") - F.when(F.col("origin") == "clip", 1).otherwise(0)
    return spans.where(kept).select("origin", "span_kind", "video_id", F.col("span_start").alias("start_at"), last.alias("end_at"))


QUERIES = {"p4_found": found}

SQL = {
    "p4_found": """
with r as (
  select 'asr' as origin, video_id, cast(round(start_sec * 1000) as bigint) as a, cast(round(end_sec * 1000) as bigint) as b from asr_segments
  union all
  select 'clip', video_id, start_frame, end_frame + 1 from clips where end_frame >= start_frame),
v as (select * from r where a is not null and b is not null and b >= a),
m as (select *, max(b) over (partition by origin, video_id order by a, b rows between unbounded preceding and 1 preceding) as before from v),
i as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by origin, video_id order by a, b rows unbounded preceding) as island from m),
p as (select origin, video_id, island, min(a) as a, max(b) as b from i group by all),
g as (select origin, video_id, b as a, lead(a) over (partition by origin, video_id order by a) as b from p),
s as (select origin, 'period' as span_kind, video_id, a, b from p
  union all
  select origin, 'gap', video_id, a, b from g where b is not null and b - a <= case origin when 'asr' then 600000 else 15000 end)
select origin, span_kind, video_id, a as start_at, b - case origin when 'clip' then 1 else 0 end as end_at from s
""",
}
