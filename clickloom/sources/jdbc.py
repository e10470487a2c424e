"""Database tables over JDBC. The driver jar comes with spark-submit; addresses and
credentials come from the caller or the environment, never from this file."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

PARALLEL_WRITERS = 10
ROWS_PER_BATCH = 1_000


class Split(NamedTuple):
    """A numeric or time column and the range of it that is shared out; rows beyond the bounds go
    to the outer parts, none is left out."""

    column: str
    lower: int | str
    upper: int | str
    parts: int


def connection_options(environ: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Reads JDBC_URL, JDBC_USER, JDBC_PASSWORD and JDBC_DRIVER; unset ones are left out."""
    names = {
        "url": "JDBC_URL",
        "user": "JDBC_USER",
        "password": "JDBC_PASSWORD",
        "driver": "JDBC_DRIVER",
    }
    return {option: environ[name] for option, name in names.items() if environ.get(name)}


def write_options(
    connection: Mapping[str, str], table: str, rows_per_batch: int = ROWS_PER_BATCH
) -> dict[str, str]:
    return {
        **connection,
        "dbtable": table,
        "batchsize": str(rows_per_batch),
        # An overwrite empties the table and keeps its declared types and keys.
        "truncate": "true",
    }


def read_options(
    connection: Mapping[str, str], table: str, split: Split | None = None
) -> dict[str, str]:
    options = {**connection, "dbtable": table}
    if split:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.parts),
        }
    return options


def read_table(
    spark: SparkSession, connection: Mapping[str, str], table: str, split: Split | None = None
) -> DataFrame:
    """One task reads the whole table unless `split` names how to share it out."""
    return spark.read.format("jdbc").options(**read_options(connection, table, split)).load()


def upsert_statement(table: str, staged: str, key: Sequence[str], values: Sequence[str]) -> str:
    """SQL that brings a table up to date from a staged one of the same columns: new keys are
    inserted, the values of known ones replaced. Spark writes `staged` with `write_table`; the
    caller runs this text on a connection of their own."""
    columns = ", ".join([*key, *values])
    replaced = ", ".join(f"{name} = EXCLUDED.{name}" for name in values)
    return (
        f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staged} "
        f"ON CONFLICT ({', '.join(key)}) DO UPDATE SET {replaced}"
    )


def write_table(
    frame: DataFrame,
    connection: Mapping[str, str],
    table: str,
    mode: str,
    writers: int = PARALLEL_WRITERS,
) -> None:
    """Append or overwrite through a fixed number of connections, which bounds the load on
    the database whatever the size of the frame."""
    frame.repartition(writers).write.format("jdbc").options(
        **write_options(connection, table)
    ).mode(mode).save()
