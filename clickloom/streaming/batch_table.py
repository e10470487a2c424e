"""A keyed table kept by micro-batches.

Every micro-batch overwrites its own directory, so a batch that is run again after a failure
replaces what it wrote before instead of adding to it. Readers fold the batches per key; every
`fold_every` batches the writer folds the finished ones into a snapshot and removes what the
snapshot before already covered, so folders stay few and a reader has time to finish. Table and checkpoint share one root: batch
numbers belong to the checkpoint, so the two are only ever reset together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.sources.folders import listed, partition_value, remove

Fold = Callable[[DataFrame], DataFrame]

# Batches between two snapshots.
FOLD_EVERY = 100


@dataclass(frozen=True)
class BatchTable:
    """`schema` is what a batch writes, `fold` reduces rows to one per key and must give the
    same columns back, so that its results can be folded again."""

    root: str
    name: str
    schema: T.StructType
    fold: Fold
    fold_every: int = FOLD_EVERY

    @property
    def batches(self) -> str:
        return f"{self.root}/{self.name}/batches"

    @property
    def snapshots(self) -> str:
        return f"{self.root}/{self.name}/snapshots"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/{self.name}/checkpoint"

    def create(self, spark: SparkSession) -> BatchTable:
        """Empty first entries, so a reader finds its columns before the first batch."""
        empty = spark.createDataFrame([], self.schema)
        empty.write.mode("ignore").parquet(f"{self.batches}/batch_id=-1")
        empty.write.mode("ignore").parquet(f"{self.snapshots}/upto=-1")
        return self

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch. A batch begins only after all earlier ones are finished, so those can
        be folded here, once enough of them have passed since the last fold: numbers may be
        skipped where a batch has nothing to write."""
        if batch_id - 1 - self._newest_snapshot(rows.sparkSession) >= self.fold_every:
            self.settle(rows.sparkSession, batch_id - 1)
        rows.select(*self.schema.names).write.mode("overwrite").parquet(
            f"{self.batches}/batch_id={batch_id}"
        )

    def _read(self, spark: SparkSession, path: str, partition: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(partition, T.LongType())])
        return spark.read.schema(schema).parquet(path)

    def _rows(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """Rows of the newest snapshot and of the batches after it, each with its batch_id.
        Both conditions are on partition columns: other directories are not read."""
        snapshots = self._read(spark, self.snapshots, "upto")
        batches = self._read(spark, self.batches, "batch_id")
        # From directory names alone: the newest snapshot may hold no rows.
        newest = self._newest_snapshot(spark)
        kept = snapshots.filter(F.col("upto") == newest).withColumnRenamed("upto", "batch_id")
        after = batches.filter(F.col("batch_id") > newest)
        if upto is not None:
            after = after.filter(F.col("batch_id") <= upto)
        return kept.unionByName(after)

    def _newest_snapshot(self, spark: SparkSession) -> int:
        done = listed(spark, f"{self.snapshots}/upto=*/_SUCCESS")
        return max((int(partition_value(path, "upto")) for path in done), default=-1)

    def settle(self, spark: SparkSession, upto: int) -> None:
        """Fold batches up to a finished one, and remove the folders that the snapshot before this
        one covers."""
        covered = self._newest_snapshot(spark)
        self.compact(spark, upto)
        for folder, name, last in ((self.batches, "batch_id", covered), (self.snapshots, "upto", covered - 1)):
            for path in listed(spark, f"{folder}/{name}=*"):
                # The empty first entries stay, so that a reader always finds the columns.
                if 0 <= int(partition_value(path, name)) <= last:
                    remove(spark, path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.fold(self._rows(spark)).select(*self.schema.names)

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Fold all batches up to a finished one into a snapshot. The snapshot counts only
        once it is complete; the batches it covers may then be deleted at leisure."""
        if upto > self._newest_snapshot(spark):
            folded = self.fold(self._rows(spark, upto)).select(*self.schema.names)
            folded.write.mode("overwrite").parquet(f"{self.snapshots}/upto={upto}")


def newest(key: list[str], value: str) -> Fold:
    """The value of the highest batch: for batches that carry running totals."""
    return lambda rows: rows.groupBy(*key).agg(F.max_by(value, "batch_id").alias(value))


def summed(key: list[str], value: str) -> Fold:
    """The sum over batches: for batches that carry increments."""
    return lambda rows: rows.groupBy(*key).agg(F.sum(value).alias(value))
