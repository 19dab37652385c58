"""Checking and writing answers.

A submission row has position (from 1), video_id and frame_ids: one frame for a search, the frames of
all events for a sequence. A question's row also has ``answer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import collapse_blanks

MOST_ROWS = 100


def validate(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows with ``reason``: null, 'unknown video', 'frame out of bounds' or 'frames not rising'.

    ``rows``: position, video_id, frame_ids; ``bounds``: video_id, frame_upper_bound (null: not checked).
    An empty ``bounds`` means that none are known: then only the order of the frames is checked.
    """
    b = bounds.select("video_id", "frame_upper_bound", F.lit(True).alias("_known"))
    any_bounds = bounds.limit(1).agg((F.count("*") > 0).alias("_any"))  # one row
    rising = F.forall(F.zip_with(F.slice("frame_ids", 1, F.greatest(F.size("frame_ids") - 1, F.lit(0))), F.slice("frame_ids", 2, F.size("frame_ids")), lambda a, z: a < z), lambda ok: F.coalesce(ok, F.lit(False)))
    over = F.exists("frame_ids", lambda f: f >= F.col("frame_upper_bound"))
    reason = F.when(F.col("_any") & F.col("_known").isNull(), "unknown video").when(over, "frame out of bounds").when(~rising, "frames not rising")
    return rows.join(b, "video_id", "left").crossJoin(F.broadcast(any_bounds)).withColumn("reason", reason).drop("_known", "_any", "frame_upper_bound")


def fields(rows: DataFrame) -> Column:
    """The fields of a row in order: video, frames and, where there is one, the answer on one line."""
    parts = [F.array(F.col("video_id")), F.transform("frame_ids", lambda f: f.cast("string"))]
    if "answer" in rows.columns:
        parts.append(F.when(F.col("answer").isNull(), F.array().cast("array<string>")).otherwise(F.array(collapse_blanks(F.col("answer")))))
    return F.concat(*parts)


def _checked(rows: DataFrame) -> DataFrame:
    """The rows; reading one beyond the most that a submission may hold is an error."""
    too_many = F.raise_error(F.lit(f"a submission holds at most {MOST_ROWS} rows")).cast("int")
    return rows.withColumn("position", F.when(F.col("position") <= MOST_ROWS, F.col("position")).otherwise(too_many))


def csv_lines(rows: DataFrame) -> DataFrame:
    """(position, line): the fields with commas between, quoted where CSV needs it; more than 100 rows are an error."""
    quoted = F.transform(fields(rows), lambda f: F.when(F.rlike(f, F.lit('[",\\r\\n]')), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f))
    return _checked(rows).select("position", F.concat_ws(",", quoted).alias("line"))


def as_json(rows: DataFrame, task: str = "kis") -> DataFrame:
    """One row: the submission as a JSON array of {task, fields} in order of position; more than 100 rows are an error."""
    listed = _checked(rows).select("position", fields(rows).alias("fields")).agg(F.array_sort(F.collect_list(F.struct("position", "fields"))).alias("r"))
    return listed.select(F.to_json(F.transform("r", lambda x: F.struct(F.lit(task).alias("task"), x["fields"].alias("fields")))).alias("submission"))
