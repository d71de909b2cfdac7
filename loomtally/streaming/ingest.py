"""Incremental arrival of text files: a file stream cleaned like the batch readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions.text import stripped_length, text_sha256


def arriving_texts(spark: SparkSession, folder: str, schema: str, text_column: str = "text", min_chars: int = 50, files_per_batch: int = 16) -> DataFrame:
    """A stream of (text, sha256) from Parquet files as they arrive in a folder."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    texts = rows.select(F.col(text_column).alias("text")).where(stripped_length(F.col("text")) >= min_chars)
    return texts.withColumn("sha256", text_sha256(F.col("text")))


def append_stream(stream: DataFrame, out: str, checkpoint: str):
    """Append the stream to Parquet, exactly once, until what has arrived is read."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
