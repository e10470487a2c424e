"""Row counts and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for each table, in one job."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def key_check(frame: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """One row: how many rows, rows with a null in the key, and key values held by several
    rows. Copies are counted within each task first, so no key gathers in one place."""
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    groups = frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(~has_null & (F.col("n") > 1)).alias("duplicate_keys"),
    ).select(F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"), "*")


def key_checks(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    checks = [key_check(frame, name, key) for name, (frame, key) in tables.items()]
    return reduce(DataFrame.unionByName, checks)
