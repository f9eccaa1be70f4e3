"""Sentences of a stream of documents. Segmentation keeps no state, so the batch expressions run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessella.operators.segment import segment, sentences


def read_documents(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_sentences(docs: DataFrame, *keep: str, **options) -> DataFrame:
    """One row per sentence of each arriving document; options as of ``segment``."""
    return sentences(segment(docs, **options), *keep)


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there as Parquet, exactly once, and stops."""
    return rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
