"""Reading manifests, exports and side files."""

from __future__ import annotations

import ast
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions.text import clean, collapse_blanks
from reelgrid.operators.etl import lead_end, parse_entities
from reelgrid.sources.schemas import ENTITIES, require_columns


def manifest(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """A Parquet manifest with the entity's columns checked; others stay."""
    return require_columns(spark.read.parquet(path), entity)


def typed_manifest(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Only the entity's columns, with the schema given instead of inferred."""
    return spark.read.schema(ENTITIES[entity]).parquet(path)


def row_count(spark: SparkSession, path: str) -> int:
    """From the files' footers."""
    return spark.read.parquet(path).count()


def known_videos(spark: SparkSession, path: str) -> DataFrame:
    """The different video_ids of a manifest; none if there is no file yet."""
    try:
        return spark.read.parquet(path).select("video_id").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "video_id string")
        raise


def pending(targets: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """The targets that aren't done, by id; ``limit`` is how many of them a run takes."""
    out = targets.join(done, "video_id", "left_anti").orderBy("video_id")
    return out if limit is None else out.limit(limit)


def _file_stem(pattern: str = r"([^/]+)\.[^./]+$") -> Column:
    """The video of a file: of its folder video_id=..., else its name without ending."""
    return F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"video_id=([^/]+)/", 1), F.lit("")), F.regexp_extract(F.input_file_name(), pattern, 1))


def keyframe_map(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, keyframe_n, original_frame_id, pts_sec, fps): CSV files with n, pts_time, fps and frame_idx, one per video; fps is their median.

    A file without rows is an error: its video would silently have no keyframes.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8").select([F.col(c) for c in ("n", "pts_time", "fps", "frame_idx")]).withColumn("video_id", _file_stem())
    rows = raw.select("video_id", F.expr("cast(try_cast(n as double) as int)").alias("keyframe_n"), F.expr("cast(try_cast(frame_idx as double) as bigint)").alias("original_frame_id"), F.expr("try_cast(pts_time as double)").alias("pts_sec"), F.expr("try_cast(fps as double)").alias("rate")).where("keyframe_n is not null")
    files = spark.read.format("binaryFile").load(path).select(F.coalesce(F.nullif(F.regexp_extract("path", r"video_id=([^/]+)/", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).alias("video_id")).distinct()
    empty = files.join(rows.select("video_id").distinct(), "video_id", "left_anti").limit(5).collect()  # five names for the message
    if empty:
        raise ValueError(f"empty keyframe map: {', '.join(r.video_id for r in empty)}")
    return rows.join(rows.groupBy("video_id").agg(F.median("rate").alias("fps")), "video_id").drop("rate")


def speech_spans(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, start_sec, end_sec, text, text_corrected, entities): speech CSV files for pooling over frames.

    Rows need a start, an end and any text, whatever the speech flag says; an end before the start is
    the start; the entities are the names of all kinds in one list.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    a, b = F.expr("try_cast(start as double)"), F.expr("try_cast(end as double)")
    corrected = F.trim(F.coalesce("text_corrected", F.lit("")))
    names = _all_names(F.col("entities"))
    rows = raw.select("video_id", a.alias("start_sec"), F.greatest(a, b).alias("end_sec"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.when(corrected == "nan", "").otherwise(corrected).alias("text_corrected"), names.alias("entities"), b.alias("_end"))
    return rows.where("start_sec is not null and _end is not null and (text <> '' or text_corrected <> '')").drop("_end")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _all_names(texts: pa.Array) -> pa.Array:
    """The values of all lists of a printed dictionary in order; malformed gives none."""
    out = []
    for t in texts.to_pylist():
        try:
            read = ast.literal_eval(t.strip()) if t and t.strip().startswith("{") else {}
            out.append([str(v).strip() for values in read.values() for v in values if str(v).strip()])
        except (ValueError, SyntaxError, AttributeError, TypeError, MemoryError, RecursionError):
            out.append([])
    return pa.array(out, pa.list_(pa.string()))


def speech_csv(spark: SparkSession, path: str, least_words: int = 2) -> DataFrame:
    """Segments of enriched speech CSV files: no-value spellings emptied, reversed times swapped, texts of too few words left out.

    A number that is missing or can't be read is 0; a row without a video is of the video its file is named after.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    held = {c: clean(F.col(c)) if c in raw.columns else F.lit("") for c in ("video_id", "segment", "start", "end", "duration", "text_corrected", "speech_score", "title", "author", "channel_id", "watch_url")}
    num = lambda c: F.coalesce(held[c].try_cast("double"), F.lit(0.0))
    video = F.coalesce(F.nullif(held["video_id"], F.lit("")), F.regexp_replace(_file_stem(), "_segments.*$", ""))
    rows = raw.select(video.alias("video_id"), num("segment").cast("int").alias("segment"), F.least(num("start"), num("end")).alias("start_sec"), F.greatest(num("start"), num("end")).alias("end_sec"), num("duration").alias("duration"), held["text_corrected"].alias("text_corrected"), num("speech_score").alias("speech_score"), parse_entities("entities").alias("e"), *[held[c].alias(c) for c in ("title", "author", "channel_id", "watch_url")])
    e = [F.col(f"e.{c}").alias(f"asr_{c}") for c in ("persons", "orgs", "locations")]
    return rows.where(F.size(F.split(collapse_blanks(F.col("text_corrected")), " ")) >= least_words).select("*", *e).drop("e")


def detections_json(spark: SparkSession, path: str) -> DataFrame:
    """(source, labels, scores): one JSON file per keyframe with parallel, sorted arrays."""
    raw = spark.read.json(path, multiLine=True, schema="detection_class_entities array<string>, detection_scores array<string>")
    return raw.select(F.input_file_name().alias("source"), F.col("detection_class_entities").alias("labels"), F.transform("detection_scores", lambda s: s.cast("double")).alias("scores"))


def caption_spans(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, start_sec, end_sec, text): caption JSON files; a caption ends where the next begins, never before its start."""
    raw = spark.read.text(path, wholetext=True).select(_file_stem().alias("video_id"), F.explode(F.from_json("value", "array<struct<start:double,duration:double,text:string>>")).alias("c")).select("video_id", "c.*")
    w = W.partitionBy("video_id").orderBy("start", "text")
    return raw.where("start is not null and trim(text) <> ''").select("video_id", F.col("start").alias("start_sec"), lead_end(F.col("start"), F.coalesce("duration", F.lit(0.0)), F.lead("start").over(w)).alias("end_sec"), "text")


def shot_lists(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, shot_id, start_frame, end_frame): files with [[start, end], ...], numbered in order of start."""
    raw = spark.read.text(path, wholetext=True).select(_file_stem().alias("video_id"), F.array_sort(F.from_json("value", "array<array<bigint>>")).alias("s"))
    return raw.select("video_id", F.posexplode("s").alias("shot_id", "r")).select("video_id", "shot_id", F.col("r")[0].alias("start_frame"), F.col("r")[1].alias("end_frame"))


def shot_csv(spark: SparkSession, path: str) -> DataFrame:
    """Shots of a CSV with video_id, start_frame, end_frame and maybe shot_id, else their place by start."""
    raw = spark.read.csv(path, header=True)
    missing = {"video_id", "start_frame", "end_frame"} - set(raw.columns)
    if missing:
        raise ValueError(f"shot CSV lacks {', '.join(sorted(missing))}")
    rows = raw.select("video_id", F.col("start_frame").cast("bigint").alias("start_frame"), F.col("end_frame").cast("bigint").alias("end_frame"), *([F.col("shot_id").cast("int").alias("shot_id")] if "shot_id" in raw.columns else []))
    return rows if "shot_id" in raw.columns else rows.withColumn("shot_id", F.row_number().over(W.partitionBy("video_id").orderBy("start_frame")) - 1)


def keyframe_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, original_frame_id, path) from image files named <video>_<frame> with a picture's ending; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.regexp_extract("path", r"(?i)(L\d{2}_V\d{3})_\d+\.(?:jpg|jpeg|png)$", 1).alias("video_id"), F.regexp_extract("path", r"(?i)_(\d+)\.(?:jpg|jpeg|png)$", 1).cast("bigint").alias("original_frame_id"), "path").where("video_id <> ''")


def ocr_lines(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, keyframe_n, text, score): one row per region of JSON lines with parallel texts and scores."""
    raw = spark.read.json(path, schema="video_id string, keyframe_n int, texts array<string>, scores array<double>", mode="DROPMALFORMED")
    return raw.select("video_id", "keyframe_n", F.explode(F.arrays_zip("texts", "scores")).alias("r")).select("video_id", "keyframe_n", F.col("r.texts").alias("text"), F.col("r.scores").alias("score"))


def caption_csv(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, keyframe_n, caption): CSV files of keyframe and response, in UTF-16 with a mark or else UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for b in batches:
            out: list[list] = [[], [], []]
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = raw.decode("utf-16") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.decode("utf-8-sig", "replace")
                folder = re.search(r"video_id=([^/]+)/", p)
                video = folder[1] if folder else re.sub(r"\.[^.]*$", "", p.rsplit("/", 1)[-1])
                for r in csv.DictReader(io.StringIO(text)):
                    n = re.match(r"\d+", r.get("keyframe") or "")
                    if n:
                        for column, v in zip(out, (video, int(n[0]), (r.get("response") or "").strip())):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["video_id", "keyframe_n", "caption"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "video_id string, keyframe_n int, caption string")


def enrichment_lines(spark: SparkSession, path: str, keys: tuple[str, ...] = ("video_id", "keyframe_n")) -> DataFrame:
    """JSON lines of which the last of each key counts; broken and empty lines are skipped.

    Last means: in the last file by name, there in the last split, there the last line. A split is read
    in order by one task, so its row numbers rise with the lines.
    """
    schema = "video_id string, keyframe_n int, ocr_text string, caption string, _corrupt_record string"
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.text(path).select(place.alias("place"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    rows = rows.where("r._corrupt_record is null and r.video_id is not null").select("place", "r.video_id", "r.keyframe_n", "r.ocr_text", "r.caption").where("coalesce(ocr_text, '') <> '' or coalesce(caption, '') <> ''")
    rest = ["ocr_text", "caption"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "place").alias("x")).select(*keys, "x.ocr_text", "x.caption")


def feature_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, keyframe_n, v): .npy files with one row per keyframe, numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.load(io.BytesIO(raw), allow_pickle=False).astype(np.float32)
                x = x.reshape(len(x), -1)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([re.sub(r"\.npy$", "", p.rsplit("/", 1)[-1])] * len(x)), pa.array(np.arange(1, len(x) + 1), pa.int32()), v], ["video_id", "keyframe_n", "v"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInArrow(run, "video_id string, keyframe_n int, v array<float>")


# Fixed value: an id of 11 characters after what comes before it in an address.
_URL_ID = r"(?:v=|youtu\.be/|/embed/|/shorts/|/vi/)([A-Za-z0-9_-]{11})"


def video_url_id(url: Column) -> Column:
    """The id in a watch address: its v parameter, else the last part of a short address."""
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.nullif(F.regexp_extract(url, _URL_ID, 1), F.lit("")))


def media_info_id(text: Column) -> Column:
    """The id in a media-info JSON text: of its watch address, else the first that any of its values holds; null if none does."""
    watch = F.get_json_object(text, "$.watch_url")
    return F.coalesce(F.nullif(F.regexp_extract(watch, _URL_ID, 1), F.lit("")), F.nullif(F.regexp_extract(text, _URL_ID, 1), F.lit("")))


def eval_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="query_id string, query_text string, source string, video_id string, answer_shot_ids array<int>, answer_frame_ids array<bigint>, start_sec double, entities array<string>, distinctiveness double, reviewed boolean")


def probe(spark: SparkSession, path: str, read) -> DataFrame:
    """Video containers through ``read(bytes) -> dict`` of the video schema; decoding itself is the caller's."""
    fields = ENTITIES["video"].names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append({"video_id": re.sub(r"\.[^.]*$", "", p.rsplit("/", 1)[-1]), **{k: None for k in fields}, "path": p, **read(raw)})
            yield from pa.Table.from_pylist(rows, pa.schema([(f, _ARROW[f]) for f in ENTITIES["video"].names])).to_batches()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ENTITIES["video"])


_ARROW = {"video_id": pa.string(), "path": pa.string(), "fps_num": pa.int32(), "fps_den": pa.int32(), "nb_frames": pa.int64(), "duration_sec": pa.float64(), "width": pa.int32(), "height": pa.int32(), "rotation": pa.int32(), "is_vfr": pa.bool_(), "codec": pa.string()}


def media_info(text: Column) -> Column:
    """STRUCT<title, author, watch_url, length> of a media-info JSON text."""
    return F.from_json(text, "title string, author string, watch_url string, length bigint")


