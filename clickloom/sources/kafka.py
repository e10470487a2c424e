"""Event topic as a streaming source and a sink.

The broker connector is a separate Spark package (`spark-sql-kafka-0-10`), supplied with
`--packages` when the job is submitted. The file source yields frames of the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC = "click_events"
OFFSETS_PER_TRIGGER = 100_000


def source_options(
    servers: str,
    topic: str = TOPIC,
    offsets_per_trigger: int = OFFSETS_PER_TRIGGER,
    starting_offsets: str = "latest",
    fail_on_data_loss: bool = True,
) -> dict[str, str]:
    """`fail_on_data_loss=False` goes on where offsets are gone, and so skips messages."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "maxOffsetsPerTrigger": str(offsets_per_trigger),
        "startingOffsets": starting_offsets,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }


def read_topic(spark: SparkSession, servers: str, **options) -> DataFrame:
    """One string column `value` per message."""
    stream = spark.readStream.format("kafka").options(**source_options(servers, **options)).load()
    return stream.select(F.col("value").cast("string").alias("value"))


def write_topic(values: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Publish a frame with a `value` column."""
    values.select("value").write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def read_files(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of message lines from a folder; the same `value` column as the topic."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def write_files(values: DataFrame, folder: str) -> None:
    values.select("value").write.mode("append").text(folder)
