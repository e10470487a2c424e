"""CSV input with declared types, and Parquet output."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.periods import utc_day
from clickloom.functions.values import id_or_null, number_or_null


def normalise_header(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[name.strip().lower() for name in frame.columns])


def conform(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns by name. A value that does not parse, a not-a-number and
    a column the frame lacks all become null; columns outside the schema are dropped."""

    def column(field: T.StructField):
        if field.name not in frame.columns:
            value = F.lit(None).cast(field.dataType)
        else:
            value = _parsed(F.col(field.name), field.dataType)
        return value.alias(field.name)

    return frame.select(*[column(field) for field in schema.fields])


def _parsed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        # A column with gaps is often written as 11.0.
        return id_or_null(value).try_cast(kind)
    value = value.try_cast(kind)
    return number_or_null(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text. Quotes within quoted text are doubled. With `multi_line` such text
    may hold line breaks; a file is then read by one task, so large inputs come as many files, or
    without line breaks and with `multi_line=False`."""
    text = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multi_line)
    return normalise_header(text)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """Columns are found by header name, in any order and any case."""
    return conform(read_csv_text(spark, path, multi_line), schema)


def read_csv_tables(
    spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType], multi_line: bool = True
) -> dict[str, DataFrame]:
    return {
        name: read_csv(spark, f"{folder}/{name}.csv", schema, multi_line)
        for name, schema in schemas.items()
    }


def _lost(text: DataFrame, schema: T.StructType) -> dict[str, Column]:
    """Per column of the schema that the text has: how many values are there and do not parse.
    Not-a-number counts as absent."""

    def lost(field: T.StructField) -> Column:
        value = F.col(field.name)
        absent = value.isNull() | F.lower(F.trim(value)).isin("", "nan", "null")
        return F.count_if(~absent & _parsed(value, field.dataType).isNull())

    return {field.name: lost(field) for field in schema.fields if field.name in text.columns}


def lost_values(text: DataFrame, schema: T.StructType) -> DataFrame:
    """(column_name, n_lost) for each column of the schema, in a pass of its own."""
    lost = _lost(text, schema)
    counts = text.agg(*[count.alias(name) for name, count in lost.items()])
    return counts.unpivot([], list(lost), "column_name", "n_lost")


class LoadAudit:
    """Rows read and values lost of one input, observed while something else is done with its rows:
    `rows` is the input in its declared types, to be written once; then `report` tells."""

    def __init__(self, text: DataFrame, schema: T.StructType):
        self.seen = Observation()
        self.lost = _lost(text, schema)
        counts = [count.alias(f"lost {name}") for name, count in self.lost.items()]
        watched = text.observe(self.seen, F.count(F.lit(1)).alias("rows"), *counts)
        self.rows = conform(watched, schema)

    def report(self) -> tuple[int, dict[str, int]]:
        """Rows, and lost values by column. Waits for the write."""
        found = self.seen.get
        return found["rows"], {name: found[f"lost {name}"] for name in self.lost}


def replace_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def append_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def with_event_date(log: DataFrame) -> DataFrame:
    return log.withColumn("event_date", utc_day(F.col("timestamp")))


def append_click_log(log: DataFrame, path: str) -> None:
    """Append to a log partitioned by UTC day.

    `rebalance` sizes the output files at run time: a day that holds much of the data is
    split over tasks and small days are packed together.
    """
    days = with_event_date(log).hint("rebalance", "event_date")
    days.write.mode("append").partitionBy("event_date").parquet(path)
