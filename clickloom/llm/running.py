"""Running totals and row numbers over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.sources.staging import Staging


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; a null matches a null. The right side's keys are dropped."""
    renamed = right.withColumnsRenamed({key: f"_{key}" for key in keys})
    on = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    return left.join(renamed, on, how).drop(*[f"_{key}" for key in keys])


def with_running_total(
    rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """`rows` with a column `name`: the sum of `value` over the rows before, in the row's group.

    The buckets of a group lie one after the other in its order. A window sees one bucket at a
    time, and one row per bucket where the buckets' own starts are added up, so a group that
    holds most rows is spread over as many tasks as it has buckets. `rows` is read twice.
    """
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = matched(rows, starts, [*group, bucket])
    total = F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return summed.withColumn(name, total).drop("_start")


def numbered(rows: DataFrame, order: Sequence[Column], name: str, staging: Staging) -> DataFrame:
    """`rows` with their place in a total order, from 0. They are range-partitioned, numbered within
    their partition and written; one row per partition says where each begins."""
    placed = staging.put(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    # The upper bits are the partition's, the lower 33 the row's.
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"_part": part, "_row": row})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_place", "_start")
