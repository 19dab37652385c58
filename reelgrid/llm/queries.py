"""Queries of problems 1-3 and 5-10 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.canonical import with_canonical
from reelgrid.llm.mixing import mix_sources, quality_weight
from reelgrid.llm.neighbours import similar_vectors
from reelgrid.llm.names import link_names, name_clusters
from reelgrid.llm.nearest_time import nearest_in_time
from reelgrid.llm.pii import personal_data, redact
from reelgrid.llm.rank_walk import rank_walk
from reelgrid.llm.tokenizer import encode_corpus
from reelgrid.llm.turns import speaker_turns
from reelgrid.session import once_per_key, table

TOLERANCE_MS = 1500


def _ms(c: str):
    return F.when(~F.isnan(c), F.round(F.col(c) * 1000)).cast("bigint")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "frame_vectors"), "point_id", "dense_video", k=10, dim=96, least_cosine=0.8)
    return near.select(F.least("point_a", "point_b").alias("point_a"), F.greatest("point_a", "point_b").alias("point_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar points of every point, whatever their cosine."""
    return similar_vectors(table(spark, sf_dir, "frame_vectors"), "point_id", "dense_video", k=10, dim=96, probes=6)


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of every query in one order."""
    candidates = once_per_key(table(spark, sf_dir, "stage_a_candidates"), ["query_id", "video_id"], "scored_at")
    speech = once_per_key(table(spark, sf_dir, "asr_segments").select("video_id", "segment", "speech_score", "ingested_at"), ["video_id", "segment"])
    evidence = speech.select("video_id", F.col("segment").alias("evidence_segment"), "speech_score")
    joined = candidates.join(evidence, ["video_id", "evidence_segment"], "left")
    # Arrays of one query are as long as its events are many; the fixed scores come first.
    scores = F.concat(F.array("score", "overview_score", "speech_score"), F.coalesce("event_scores", F.array().cast("array<double>")))
    return rank_walk(joined.select("query_id", "video_id", scores.alias("scores")), "query_id", "video_id", "scores")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_ranking(spark, sf_dir).where("place <= 3").select("query_id", "video_id")


def _screen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the three text fields, once: pieces of ocr_text, otherwise whole texts."""
    frames = table(spark, sf_dir, "frames")
    ocr = frames.select(F.lit("ocr_text").alias("field_name"), "video_id", F.col("keyframe_n").alias("row_no"), F.explode(F.split("ocr_text", " · ")).alias("value"))
    caption = frames.select(F.lit("caption_vi").alias("field_name"), "video_id", F.col("keyframe_n").alias("row_no"), F.col("caption_vi").alias("value"))
    speech = table(spark, sf_dir, "asr_segments").select(F.lit("text_corrected").alias("field_name"), "video_id", F.col("segment").alias("row_no"), F.col("text_corrected").alias("value"))
    return ocr.unionByName(caption).unionByName(speech)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The phrases are a small table that doesn't grow; Spark broadcasts it if its size allows.
    phrases = with_canonical(table(spark, sf_dir, "screen_phrases").select("phrase_id", "phrase"), "phrase")
    values = with_canonical(_screen_values(spark, sf_dir).where("value is not null"), "value")
    return values.join(phrases, "form").where("value <> phrase").select("field_name", "video_id", "row_no", "phrase_id").distinct()


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the three fields in their consistent form, with the key of their row."""
    return with_canonical(_screen_values(spark, sf_dir), "value").distinct()


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of every segment: video_id, segment, kind, name."""
    lists = [("person", "asr_persons"), ("org", "asr_orgs"), ("location", "asr_locations")]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("names")) for k, c in lists])
    speech = table(spark, sf_dir, "asr_segments")
    return speech.select("video_id", "segment", F.explode(kinds).alias("l")).select("video_id", "segment", F.col("l.kind").alias("kind"), F.explode("l.names").alias("name")).where("name is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt, known = _spelt(spark, sf_dir), table(spark, sf_dir, "known_entities")
    links = link_names(spelt, known).join(known.select("entity_id", "full_name"), "entity_id").where("name <> full_name").select("kind", "name", "entity_id")
    return spelt.join(links, ["kind", "name"]).select(F.col("kind").alias("entity_kind"), "video_id", "segment", "entity_id").distinct()


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different spelling with its cluster, also of people, organisations and places that nobody lists."""
    return name_clusters(_spelt(spark, sf_dir), table(spark, sf_dir, "known_entities"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "frames").select("video_id", "keyframe_n", _ms("pts_sec").alias("at"))
    speech = table(spark, sf_dir, "asr_segments").select("video_id", "segment", _ms("start_sec").alias("at"))
    near = nearest_in_time(frames, speech, "video_id", "at", "at", "keyframe_n", "segment", TOLERANCE_MS)
    return near.select("video_id", F.col("probe_id").cast("int").alias("keyframe_n"), F.col("base_id").cast("int").alias("segment"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(table(spark, sf_dir, "transcripts"), "transcript_id", "segments").select("transcript_id", "turn_no", "speaker", "n_words").distinct()


def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with their words and times."""
    return speaker_turns(table(spark, sf_dir, "transcripts"), "transcript_id", "segments").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), ["doc_id"], "text", "byte_bpe_50k")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", quality_weight(F.col("text")).alias("weight"))
    sized = encode_corpus(docs, ["doc_id", "source", "weight"], "text").select("doc_id", "source", "weight", F.size("ids").alias("n_tokens"))
    return mix_sources(sized, table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]



def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pii_kind", "start_at").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by placeholders."""
    return redact(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p2_found": p2_found, "p2_ranking": p2_ranking, "p3_found": p3_found, "p3_canonical": p3_canonical, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_found": p6_found, "p7_found": p7_found, "p7_turns": p7_turns, "p8_ids": p8_ids, "p9_shares": p9_shares, "p9_mixture": p9_mixture, "p10_found": p10_found, "p10_redacted": p10_redacted}

SQL = {
    "p6_found": """
with p as (select distinct video_id, keyframe_n, cast(round(pts_sec * 1000) as bigint) as t from frames where pts_sec is not null and video_id is not null),
b as (select distinct video_id, segment, cast(round(start_sec * 1000) as bigint) as s from asr_segments where start_sec is not null and segment is not null),
j as (select p.video_id, p.keyframe_n, b.segment, row_number() over (partition by p.video_id, p.keyframe_n order by abs(t - s), s, segment) as rn
  from p join b on p.video_id = b.video_id and abs(t - s) <= 1500)
select video_id, keyframe_n, segment from j where rn = 1
""",
}
