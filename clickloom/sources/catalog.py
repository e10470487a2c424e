"""Named tables in the session catalogue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.schemas import DERIVED_TABLES, LIVE_TABLES, PARTITIONED_BY, STATIC_TABLES


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create whichever tables are missing."""
    for name, schema in {**STATIC_TABLES, **LIVE_TABLES, **DERIVED_TABLES}.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        days = PARTITIONED_BY.get(name)
        partitioning = f" PARTITIONED BY ({', '.join(days)})" if days else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{partitioning}"
        )


def table(spark: SparkSession, name: str, database: str = "default") -> DataFrame:
    return spark.table(f"{database}.{name}")


def replace_table(
    frame: DataFrame,
    name: str,
    database: str = "default",
    bucket_key: str | None = None,
    buckets: int | None = None,
) -> None:
    """Full replacement. Bucketing two tables alike on their join key (orders and their
    items on order_id) lets the join run without shuffling either."""
    writer = frame.write.mode("overwrite").format("parquet")
    if name in PARTITIONED_BY:
        writer = writer.partitionBy(*PARTITIONED_BY[name])
    if bucket_key and buckets:
        writer = writer.bucketBy(buckets, bucket_key).sortBy(bucket_key)
    writer.saveAsTable(f"{database}.{name}")


def append_table(frame: DataFrame, name: str, database: str = "default") -> None:
    schema = {**STATIC_TABLES, **LIVE_TABLES, **DERIVED_TABLES}[name]
    frame.select(*schema.names).write.insertInto(f"{database}.{name}")


def truncate_live_tables(
    spark: SparkSession, database: str = "default", names: Iterable[str] = tuple(LIVE_TABLES)
) -> None:
    for name in names:
        spark.sql(f"TRUNCATE TABLE {database}.{name}")


def newest_day(spark: SparkSession, name: str = "user_click_logs", database: str = "default"):
    """The newest event_date of a partitioned log, from its partition list alone; a Column
    to pass as `day=` to the daily queries. Null when there is no partition yet."""
    listed = spark.sql(f"SHOW PARTITIONS {database}.{name}")
    day = F.regexp_extract("partition", r"event_date=([^/]+)", 1).cast(T.DateType())
    return listed.agg(F.max(day)).scalar()
