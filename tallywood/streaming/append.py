"""Appended JSON Lines as a stream: the same record projections, counted by event time.

A record is counted once in its window; records later than `late` are dropped by the
watermark.  This goes beyond the batch engine's scope and shares its projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.operators import records


def record_stream(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """source, path and v of each line of files that appear in a folder."""
    raw = spark.readStream.text(folder)
    return raw.select(F.lit(source).alias("source"), F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records by window and type, as an append-mode stream."""
    at = F.timestamp_millis(records.epoch_millis("v", "$.timestamp"))
    kind = F.coalesce(records.text_field("v", "$.type"), F.lit(""))
    seen = stream.select(at.alias("at"), "source", kind.alias("type")).filter("at is not null")
    return seen.withWatermark("at", late).groupBy(F.window("at", window), "source", "type").count()
