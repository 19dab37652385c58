"""Continuous ingestion: files that arrive are merged into a collection, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from reelgrid.session import once_per_key
from reelgrid.sources.schemas import ENTITIES, KEYS
from reelgrid.sources.writers import Collection


def arriving(spark: SparkSession, path: str, entity: str, arrival: str = "ingested_at", files_at_once: int = 1000) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    schema = T.StructType([*ENTITIES[entity].fields, T.StructField(arrival, T.TimestampType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def merge_into(stream: DataFrame, collection: Collection, entity: str, checkpoint: str) -> StreamingQuery:
    """Each batch is an upsert by key; the checkpoint makes a restart go on where it stopped, and a repeated batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        collection.upsert(once_per_key(batch, KEYS[entity]), KEYS[entity])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_window(stream: DataFrame, arrival: str = "ingested_at", width: str = "10 minutes", late: str = "3 days") -> DataFrame:
    """Rows per window of arrival and video; rows later than the watermark are left out."""
    return stream.withWatermark(arrival, late).groupBy(F.window(arrival, width), "video_id").agg(F.count("*").alias("rows"))
