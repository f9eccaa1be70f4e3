"""Text files in, sentences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, text``. Bytes that are not UTF-8 become the replacement character."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.decode(F.encode(F.make_valid_utf8(F.col("content").cast("string")), "UTF-8"), "UTF-8").alias("text"))


def numbered_lines(rows: DataFrame, sent: str = "sent", index: str = "sent_id") -> DataFrame:
    """``value``: ``[index] sentence`` per row."""
    return rows.select(F.format_string("[%d] %s", F.col(index), F.col(sent)).alias("value"))


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Numbered sentences as text files, ordered within each file by the given columns."""
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    numbered_lines(lines).write.text(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """One JSON object per row."""
    rows.write.json(path)
