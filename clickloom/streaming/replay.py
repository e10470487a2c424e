"""History replayed as a stream of message files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.operators.cleaning import event_messages, to_values
from clickloom.sources.kafka import read_files, write_files


def publish(clicks: DataFrame, folder: str, files: int, by: str = "timestamp") -> None:
    """Write clicks as JSON messages, each file a stretch of event time, or of another column that
    says when they are sent, in order."""
    ordered = clicks.repartitionByRange(files, by, "event_id").sortWithinPartitions(by, "event_id")
    write_files(to_values(event_messages(ordered)), folder)


def replay(spark: SparkSession, folder: str, files: int, batches: int) -> DataFrame:
    """Stream the published files in about `batches` micro-batches."""
    return read_files(spark, folder, files_per_trigger=-(-files // batches))
