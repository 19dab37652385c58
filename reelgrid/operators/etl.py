"""Joining what several jobs know about a frame, a shot or a video."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions.text import clean, quoted_spans


def last_write_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last in ``order``; an aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])


def merge_payload(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, orphans): new values over old ones where they are not null; new keys that the index lacks."""
    values = [c for c in new.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values])
    merged = old.join(n, keys, "left")
    for c in values:
        merged = merged.withColumn(c, F.coalesce(f"_n_{c}", c) if c in old.columns else F.col(f"_n_{c}")).drop(f"_n_{c}")
    return merged, new.join(old.select(*keys), keys, "left_anti")


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key isn't new, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def objects_of_shot(frames: DataFrame) -> DataFrame:
    """(video_id, shot_id, object, n): how many keyframes of each shot show an object."""
    return frames.select("video_id", "shot_id", F.explode(F.array_distinct("objects")).alias("object")).groupBy("video_id", "shot_id", "object").agg(F.count("*").alias("n"))


def detections(labels: Column, scores: Column, least: float = 0.3) -> Column:
    """MAP<label, count> of the detections before the first one under ``least``; the arrays are parallel and sorted."""
    pairs = F.arrays_zip(labels.alias("l"), scores.alias("s"))
    stop = F.array_position(F.transform(scores, lambda s: F.coalesce(s < least, F.lit(True))), True)
    kept = F.when(stop > 0, F.slice(pairs, F.lit(1), (stop - 1).cast("int"))).otherwise(pairs)
    names = F.array_sort(F.array_distinct(F.transform(kept, lambda p: p["l"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(kept, lambda p: p["l"] == n))))


def frame_upper_bound(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frame_upper_bound): the larger of floor(length x rate) and the last seen keyframe + 1; null if neither is known."""
    seen = frames.groupBy("video_id").agg(F.max("original_frame_id").alias("_last"))
    by_length = F.floor(F.try_divide(F.floor("duration_sec") * F.col("fps_num"), F.col("fps_den")))
    return videos.join(seen, "video_id", "left").select("video_id", F.greatest(by_length, F.col("_last") + 1).alias("frame_upper_bound"))


def refuse_variable_rate(videos: DataFrame) -> DataFrame:
    """The videos, or an error when a row of a variable-rate one is read."""
    return videos.withColumn("is_vfr", F.when(F.coalesce("is_vfr", F.lit(False)), F.raise_error(F.concat(F.lit("variable frame rate: "), "video_id")).cast("boolean")).otherwise(False))


def clean_names(names: Column) -> Column:
    """Distinct names in order without those that mean no value."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), clean), lambda n: n != ""))


def lead_end(start: Column, duration: Column, next_start: Column) -> Column:
    """End of a caption: where the next one starts, for the last its duration; never before its start."""
    return F.greatest(F.coalesce(next_start, start + duration), start)


ENTITY_LISTS = ("persons", "orgs", "locations")
_LISTS = pa.struct([(c, pa.list_(pa.string())) for c in ENTITY_LISTS])


def entity_lists(text: str | None) -> dict[str, list[str]]:
    """The names of each kind in a printed dictionary, cleaned, once each in order; malformed gives none."""
    empty: dict[str, list[str]] = {c: [] for c in ENTITY_LISTS}
    try:
        read = ast.literal_eval((text or "").strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return empty
    if not isinstance(read, dict):
        return empty
    for c in ENTITY_LISTS:
        names = read.get(c)
        if isinstance(names, (list, tuple, set)):
            kept = (str(n).strip() for n in names)
            empty[c] = list(dict.fromkeys(n for n in kept if n.lower() not in ("", "nan", "none", "null")))
    return empty


@F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ENTITY_LISTS]))
def parse_entities(texts: pa.Array) -> pa.Array:
    """STRUCT<persons, orgs, locations> from the printed form of a dictionary, which only Python's own reader takes apart; malformed gives empty lists."""
    return pa.array([entity_lists(t) for t in texts.to_pylist()], _LISTS)


def pick_transcript(transcripts: DataFrame) -> DataFrame:
    """One transcript per video: written by hand before generated before unknown, then the smallest id."""
    order = F.struct(F.when(~F.col("is_generated"), 0).when(F.col("is_generated"), 1).otherwise(2), F.col("transcript_id"))
    rest = [c for c in transcripts.columns if c != "video_id"]
    return transcripts.groupBy("video_id").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("video_id", *[F.col("_r").getField(c).alias(c) for c in rest])


def mean_pool(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, v): each group's vectors scaled to length 1, their mean, and that scaled to length 1 again.

    Sums are taken within Arrow batches before the shuffle and merged over runs of a sorted partition
    after it, so a group of any size is one row per batch and never in one place. Null vectors and such
    without a length are left out; a mean of no length is null. All vectors are of one size.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("v"))
    kinds = ", ".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys)
    sums = rows.mapInArrow(lambda b: _sums(b, len(keys)), f"{kinds}, n bigint, v array<double>")
    ordered = sums.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return ordered.mapInArrow(lambda b: _means(b, len(keys)), f"{kinds}, n bigint, v array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _groups(b: pa.RecordBatch, keys: int) -> np.ndarray:
    """A number for each row's key, null being a value like any other."""
    code = np.zeros(b.num_rows, np.int64)
    for i in range(keys):
        d = b.column(i).dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    return code


def _batch(b: pa.RecordBatch, keys: int, at: np.ndarray, n: np.ndarray, x: np.ndarray, empty: np.ndarray | None = None) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    v = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()), mask=None if empty is None else pa.array(empty))
    return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)) for i in range(keys)), pa.array(n, pa.int64()), v], [*b.schema.names[:keys], "n", "v"])


def _sums(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x = _matrix(b.column(keys))
        length = np.sqrt((x * x).sum(axis=1))
        good = np.flatnonzero(length > 0)
        if not len(good):
            continue
        code = _groups(b, keys)[good]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
        unit = x[good[order]] / length[good[order], None]
        yield _batch(b, keys, good[order[starts]], np.diff([*starts, len(order)]), np.add.reduceat(unit, starts, axis=0))


def _means(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    held: pa.RecordBatch | None = None  # the sums of the last key so far, which may go on in the next batch

    def scaled(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(b.column(keys + 1))
        length = np.sqrt((x * x).sum(axis=1))
        none = length <= 1e-12 * b.column(keys).to_numpy()
        return _batch(b, keys, np.arange(len(x)), b.column(keys).to_numpy(), x / np.where(none, 1, length)[:, None], none)

    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(_groups(b, keys)) != 0]))
        merged = _batch(b, keys, starts, np.add.reduceat(b.column(keys).to_numpy(), starts), np.add.reduceat(_matrix(b.column(keys + 1)), starts, axis=0))
        held = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield scaled(merged.slice(0, merged.num_rows - 1))
    if held is not None:
        yield scaled(held)


def nearest_rank(values: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, value): the value at position int(n x share) of the sorted values, without interpolation."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    n = values.withColumn("_p", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return n.where(F.col("_p") == F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)).select(*keys, value)


def join_captions(frames: DataFrame, captions: DataFrame) -> DataFrame:
    """Frames with ``caption_vi`` and ``ocr_text_vlm``, the quoted words of the caption; '' where there is no caption.

    ``captions``: video_id, keyframe_n, caption; columns of these names that the frames had are replaced.
    """
    keys = ["video_id", "keyframe_n"]
    kept = frames.drop("caption_vi", "ocr_text_vlm")
    joined = kept.join(captions.select(*keys, F.col("caption").alias("caption_vi")), keys, "left")
    return joined.withColumn("caption_vi", F.coalesce("caption_vi", F.lit(""))).withColumn("ocr_text_vlm", F.array_join(quoted_spans(F.col("caption_vi")), " "))


def shot_text(regions: DataFrame) -> DataFrame:
    """(video_id, shot_id, ocr_text, ocr_regions): the different regions of each shot in order of keyframe and place.

    ``regions``: video_id, shot_id, keyframe_n, pos, text. A region counts once, combined before the shuffle.
    """
    once = regions.groupBy("video_id", "shot_id", "text").agg(F.min(F.struct("keyframe_n", "pos")).alias("at"))
    listed = once.groupBy("video_id", "shot_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("r"))
    return listed.select("video_id", "shot_id", F.array_join(F.col("r.text"), " ").alias("ocr_text"), F.size("r").alias("ocr_regions"))


def with_shot_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Frames or clips with their shot's ``ocr_text`` and ``ocr_regions``; '' and 0 where it has none."""
    joined = rows.drop("ocr_text", "ocr_regions").join(texts, ["video_id", "shot_id"], "left")
    return joined.withColumn("ocr_text", F.coalesce("ocr_text", F.lit(""))).withColumn("ocr_regions", F.coalesce("ocr_regions", F.lit(0)))


def with_rate(rows: DataFrame, videos: DataFrame, fallback: tuple[int, int] | None = None) -> DataFrame:
    """Rows with fps_num and fps_den of their video, else of ``fallback``; without either, reading the row is an error."""
    v = refuse_variable_rate(videos).select("video_id", "fps_num", "fps_den")
    joined = rows.join(v, "video_id", "left")
    missing = F.raise_error(F.concat(F.lit("no frame rate for "), F.col("video_id"))).cast("int")
    for c, x in zip(("fps_num", "fps_den"), fallback or (None, None)):
        joined = joined.withColumn(c, F.coalesce(F.col(c), missing if x is None else F.lit(x)))
    return joined


def non_empty_payload(row_fields: list[str], keep: tuple[str, ...] = ()) -> Column:
    """JSON of the fields that carry something: no nulls, empty texts or lists and zeros, but for those of ``keep``."""

    def filled(c: str) -> Column:
        return F.col(c) if c in keep else F.when(~F.to_json(F.struct(F.col(c).alias("x"))).isin("{}", '{"x":""}', '{"x":[]}', '{"x":{}}', '{"x":0}', '{"x":0.0}', '{"x":false}'), F.col(c))

    return F.to_json(F.struct(*[filled(c).alias(c) for c in row_fields]))


def replace_vectors(points: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Points with another model's vector; all other columns, sparse weights among them, stay. Points without a new vector are left out."""
    return points.drop(vector).join(vectors.select(key, vector), key)
