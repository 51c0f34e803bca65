"""Continuous ingest of per-sample variant files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def variant_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """``(sample_id, pos, alt, vtype)`` of the files that arrive in a folder."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(path)
    f = F.split("value", "\t")
    sample = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.variants", 1)
    rows = lines.where("value <> '' and not startswith(value, '#')").select(sample.alias("sample_id"), F.get(f, 0).try_cast("int").alias("pos"), F.get(f, 1).alias("alt"), F.get(f, 2).alias("vtype"))
    return rows.where("pos is not null")


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table exactly once, then stop."""
    return variant_stream(spark, source).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
