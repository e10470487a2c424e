"""What the dashboard polls, kept up to date by every micro-batch.

Three small tables stand for the log: events counted by day, session, user and type; sales by session
and day; and the newest distinct events. Each batch writes its own part, parts are merged when read,
and a poll reads the day it is about, or no more than the buffer, whatever the log has grown to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from clickloom.operators import daily, live, sales
from clickloom.operators.cleaning import accepted, checked_messages, log_rows
from clickloom.schemas import CLICK_LOG
from clickloom.streaming.batch_table import BatchTable
from clickloom.streaming.day_log import DayLog
from clickloom.streaming.jobs import CLOSE_EVERY

# Distinct events of the live panels.
BUFFER = 200


def _fields(*names: str, **more: T.DataType) -> T.StructType:
    return T.StructType([*[CLICK_LOG[name] for name in names], *[T.StructField(n, t) for n, t in more.items()]])


@dataclass(frozen=True)
class Panels:
    """`sessions` of the calls below are the landed sessions, `products` the catalogue."""

    root: str
    buffer: int = BUFFER

    @property
    def counts(self) -> DayLog:
        return DayLog(self.root, "event_counts", _fields(*daily.COUNTED, n_events=T.LongType()), daily.event_counts)

    @property
    def sales(self) -> DayLog:
        columns = ("event_date", "session_id", "event_type", "timestamp", "amount_usd")
        return DayLog(self.root, "sales", _fields(*columns), sales.sale_facts)

    @property
    def newest(self) -> BatchTable:
        return BatchTable(self.root, "newest", CLICK_LOG, lambda rows: live.newest_distinct(rows, self.buffer))

    def parts(self, *names: str) -> list[tuple[DayLog | BatchTable, Callable[[DataFrame], DataFrame]]]:
        """The tables of some names (all, if none is named), and what a batch writes to each."""
        tables = {
            "counts": (self.counts, daily.event_counts),
            "sales": (self.sales, sales.sale_facts),
            "newest": (self.newest, lambda rows: live.newest_distinct(rows, self.buffer)),
        }
        return [tables[name] for name in names or tables]

    def create(self, spark: SparkSession, *names: str) -> Panels:
        for table, _ in self.parts(*names):
            table.create(spark)
        return self

    def write(self, clicks: DataFrame, batch_id: int, *names: str) -> None:
        """A batch of click-log rows. Run again, it replaces what it wrote."""
        for table, part in self.parts(*names):
            table.write(part(clicks), batch_id)

    def close(self, spark: SparkSession, upto: int, *names: str) -> None:
        """Reduce the days that are over; batches up to `upto` are finished."""
        for table, _ in self.parts(*names):
            if isinstance(table, DayLog):
                table.close(spark, upto)

    def job(self, values: DataFrame, close_every: int = CLOSE_EVERY) -> DataStreamWriter:
        self.create(values.sparkSession)

        def write(batch: DataFrame, batch_id: int) -> None:
            if batch_id and batch_id % close_every == 0:
                self.close(batch.sparkSession, batch_id - 1)
            batch.persist()
            try:
                if not batch.isEmpty():
                    self.write(batch, batch_id)
            finally:
                batch.unpersist()

        return (
            log_rows(accepted(checked_messages(values)))
            .writeStream.option("checkpointLocation", f"{self.root}/panels-checkpoint")
            .foreachBatch(write)
        )

    # --- panels ----------------------------------------------------------------------------

    def _day(self, spark: SparkSession, day: Column | None) -> tuple[DataFrame, Column]:
        return self.counts.read(spark), self.counts.newest_day(spark) if day is None else day

    def daily_kpis(self, spark: SparkSession, day: Column | None = None) -> DataFrame:
        return daily.daily_kpis(*self._day(spark, day))

    def active_countries(self, spark: SparkSession, sessions: DataFrame, day: Column | None = None) -> DataFrame:
        counts, day = self._day(spark, day)
        return daily.active_countries(counts, sessions, day)

    def device_source(self, spark: SparkSession, sessions: DataFrame, day: Column | None = None) -> DataFrame:
        counts, day = self._day(spark, day)
        return daily.device_source(counts, sessions, day)

    def sales_trend(
        self, spark: SparkSession, granularity: str = "month",
        year: int | None = None, month: int | None = None, day: int | None = None,
    ) -> DataFrame:
        return sales.sales_trend(self.sales.read(spark), granularity, year, month, day)

    def sales_filters(self, spark: SparkSession) -> DataFrame:
        return sales.sales_filters(self.sales.read(spark))

    def live_feed(self, spark: SparkSession, limit: int = 100) -> DataFrame:
        return live.live_feed(self.newest.read(spark), min(limit, self.buffer))

    def live_top_products(self, spark: SparkSession, products: DataFrame, limit: int = 8) -> DataFrame:
        return live.live_top_products(self.newest.read(spark), products, self.buffer, limit)
