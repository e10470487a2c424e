"""A landed log, partitioned by day, whose folders stay few.

A micro-batch overwrites `rows/event_date=D/batch_id=B`, so a batch that is run again replaces itself.
At a trigger of seconds that makes thousands of folders a day. Once a day is over, `close` rewrites its
batches as one set of files, `days/event_date=D/upto=U`, and then notes (D, U) in the `closed` table.
The note is what counts: until it is there readers take the batches, afterwards the day and only the
batches above U, which are events that came late. A day that has gathered enough late batches is closed
again, together with what it was closed with before. Folders that a note covers are removed by the next
call, so a reader that has listed them has until then to finish.

The `counts` table has the events per day of every batch: which days there are, and how many events
each has, is known without opening a file of the log.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.sources.folders import listed, partition_value, remove, remove_if_empty
from clickloom.streaming.batch_table import BatchTable, Fold

# Batches of a closed day that make closing it again worth its rewriting.
LATE_BATCHES = 50


def _days_of(paths: list[str]) -> dict[date, list[tuple[int, str]]]:
    """Folders by day, with the batch number each carries. Rows without a day are of no day that ends."""
    found: dict[date, list[tuple[int, str]]] = {}
    for path in paths:
        day = partition_value(path, "event_date")
        if day != "__HIVE_DEFAULT_PARTITION__":
            number = int(path.rstrip("/").rsplit("=", 1)[1])
            found.setdefault(date.fromisoformat(day), []).append((number, path))
    return found


@dataclass(frozen=True)
class DayLog:
    """`schema` has an `event_date`, by which rows are partitioned. With a `fold`, rows of a day that
    is closed are reduced by it; readers reduce them again, together with those not yet closed."""

    root: str
    name: str
    schema: T.StructType
    fold: Fold | None = None

    @property
    def rows(self) -> str:
        return f"{self.root}/{self.name}/rows"

    @property
    def days(self) -> str:
        return f"{self.root}/{self.name}/days"

    @property
    def counts(self) -> BatchTable:
        schema = "event_date date, n long"
        fold = lambda rows: rows.groupBy("event_date").agg(F.sum("n").alias("n"))
        return BatchTable(f"{self.root}/{self.name}", "counts", T.StructType.fromDDL(schema), fold)

    @property
    def closed(self) -> BatchTable:
        schema = "event_date date, last_batch long"
        fold = lambda rows: rows.groupBy("event_date").agg(F.max("last_batch").alias("last_batch"))
        return BatchTable(f"{self.root}/{self.name}", "closed", T.StructType.fromDDL(schema), fold)

    def create(self, spark: SparkSession) -> DayLog:
        for table in (self.counts, self.closed):
            table.create(spark)
        # An empty first entry, so that readers find the folder.
        first = f"{self.rows}/event_date=__HIVE_DEFAULT_PARTITION__/batch_id=-1"
        spark.createDataFrame([], self.schema).drop("event_date").write.mode("ignore").parquet(first)
        return self

    def _with(self, number: str) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(number, T.LongType())])

    # --- writing ---------------------------------------------------------------------------

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch. Its rows are read twice: for the log and for the counts."""
        rows = rows.select(*self.schema.names)
        self.counts.write(rows.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")), batch_id)
        (
            rows.hint("rebalance", "event_date")
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("event_date", "batch_id")
            .parquet(self.rows)
        )

    def close(
        self, spark: SparkSession, upto: int, before: date | None = None, late_batches: int = LATE_BATCHES
    ) -> list[date]:
        """Close the days before one (the newest, unless named), from batches up to a finished one.
        Days closed already are closed again when that many late batches lie beside them. Returns
        the days it has rewritten; all of them are rewritten by one job."""
        marks = self.marks(spark)
        self._remove_covered(spark, marks)
        batches = _days_of(listed(spark, f"{self.rows}/event_date=*/batch_id=*"))
        before = before or max(batches, default=date.min)
        chosen = {}
        for day, folders in batches.items():
            fresh = [path for number, path in folders if marks.get(day, -1) < number <= upto]
            if day < before and len(fresh) >= (late_batches if day in marks else 1):
                chosen[day] = fresh
        if not chosen:
            return []
        kept = {day: marks[day] for day in chosen if day in marks}
        found = self._read(spark, self.rows, "batch_id", [p for paths in chosen.values() for p in paths])
        found = found.unionByName(self._closed_rows(spark, kept))
        if self.fold:
            found = self.fold(found).select(*self.schema.names)
        (
            found.hint("rebalance", "event_date")
            .withColumn("upto", F.lit(upto).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("event_date", "upto")
            .parquet(self.days)
        )
        # One file, so the days are closed all at once; with those that an earlier call closed
        # up to the same batch, whose notes it replaces.
        same = {day for day, mark in marks.items() if mark == upto}
        notes = spark.createDataFrame([(day, upto) for day in same | set(chosen)], self.closed.schema)
        self.closed.write(notes.coalesce(1), upto)
        return sorted(chosen)

    def _remove_covered(self, spark: SparkSession, marks: Mapping[date, int]) -> None:
        for folder, number, gone in (
            (self.rows, "batch_id", lambda found, mark: found <= mark),
            (self.days, "upto", lambda found, mark: found < mark),
        ):
            for day, folders in _days_of(listed(spark, f"{folder}/event_date=*/{number}=*")).items():
                for found, path in folders:
                    if day in marks and gone(found, marks[day]):
                        remove(spark, path)
                remove_if_empty(spark, f"{folder}/event_date={day.isoformat()}")

    # --- reading ---------------------------------------------------------------------------

    def marks(self, spark: SparkSession) -> dict[date, int]:
        """The last batch that each closed day holds. One entry per day."""
        return {row.event_date: row.last_batch for row in self.closed.read(spark).collect()}

    def _read(self, spark: SparkSession, base: str, number: str, paths: list[str]) -> DataFrame:
        if not paths:
            return spark.createDataFrame([], self.schema)
        reader = spark.read.schema(self._with(number)).option("basePath", base)
        return reader.parquet(*paths).select(*self.schema.names)

    def _closed_rows(self, spark: SparkSession, marks: Mapping[date, int]) -> DataFrame:
        paths = [f"{self.days}/event_date={day.isoformat()}/upto={upto}" for day, upto in sorted(marks.items())]
        # A day whose folder is not there was closed without rows.
        there = set(listed(spark, f"{self.days}/event_date=*/upto=*")) if paths else set()
        known = {path.split("/days/", 1)[1] for path in there}
        return self._read(spark, self.days, "upto", [p for p in paths if p.split("/days/", 1)[1] in known])

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows: the closed days and the batches that no closed day covers. Both sides are
        partitioned by day, so a filter on event_date leaves the other days' files unread."""
        marks = self.marks(spark)
        batches = spark.read.schema(self._with("batch_id")).parquet(self.rows)
        if not marks:
            return batches.select(*self.schema.names)
        pairs = [F.lit(x) for day, upto in sorted(marks.items()) for x in (day, upto)]
        covered = F.coalesce(F.create_map(*pairs)[F.col("event_date")], F.lit(-1))
        beside = batches.filter(F.col("batch_id") > covered).select(*self.schema.names)
        return self._closed_rows(spark, marks).unionByName(beside)

    def before_batch(self, spark: SparkSession, batch_id: int, days: list[date]) -> DataFrame:
        """Rows of some days as they were before a batch: what a batch that is run again wrote the
        first time is not among them."""
        marks = {day: upto for day, upto in self.marks(spark).items() if day in set(days)}
        folders = _days_of([p for day in days for p in listed(spark, f"{self.rows}/event_date={day.isoformat()}/batch_id=*")])
        paths = [p for day, found in folders.items() for n, p in found if marks.get(day, -1) < n < batch_id]
        return self._closed_rows(spark, marks).unionByName(self._read(spark, self.rows, "batch_id", paths))

    def day_counts(self, spark: SparkSession) -> DataFrame:
        """event_date and n, from the counts of the batches."""
        return self.counts.read(spark).filter("n > 0")

    def newest_day(self, spark: SparkSession) -> Column:
        """The newest day that has events, evaluated with the query that uses it."""
        return self.day_counts(spark).agg(F.max("event_date")).scalar()
