"""Continuous sources.  Files everywhere; Kafka where its connector is on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Messages as lines of text files arriving in a folder."""
    return (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
            .load(path))


def table_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*",
                 files_per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files arriving in a folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("pathGlobFilter", pattern).parquet(path))


def topic_stream(spark: SparkSession, servers: str, topic: str,
                 offsets: str = "latest") -> DataFrame:
    """Messages of one topic (needs the Kafka connector jar)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", offsets).load()
            .select(F.col("value").cast("string").alias("value"), "timestamp"))
