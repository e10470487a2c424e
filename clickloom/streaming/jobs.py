"""The streaming jobs: interest scores, click log with sessions, and the deduplicated feed.

Every function takes a streaming frame with a `value` column (topic or files alike) and
returns a configured writer; `lifecycle` starts it. The checkpoint location is not optional.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from clickloom.operators.cleaning import (
    accepted,
    checked_messages,
    log_rows,
    quarantined,
    scorer_rows,
)
from clickloom.operators.landing import (
    EVENT_KEY,
    first_per_session,
    score_increments,
    session_candidates,
)
from clickloom.schemas import CLICK_LOG, SESSIONS, USER_SCORES
from clickloom.streaming.batch_table import BatchTable, newest, summed
from clickloom.streaming.day_log import DayLog

SCORE_KEY = ["user_id", "product_id"]

# --- interest scores -----------------------------------------------------------------------


def running_scores_table(root: str) -> BatchTable:
    return BatchTable(root, "scores", USER_SCORES, newest(SCORE_KEY, "popularity_score"))


def score_increments_table(root: str) -> BatchTable:
    return BatchTable(root, "score_increments", USER_SCORES, summed(SCORE_KEY, "popularity_score"))


def running_scores(values: DataFrame, table: BatchTable) -> DataStreamWriter:
    """Sums held in streaming state. Update mode emits each changed pair's whole total, so a
    batch replaces earlier totals; adding them up would count every event again."""
    totals = score_increments(scorer_rows(values))
    return (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", table.checkpoint)
        .foreachBatch(table.write)
    )


def incremental_scores(values: DataFrame, table: BatchTable) -> DataStreamWriter:
    """The same scores without streaming state: each batch writes its own increments and the
    reader sums. The choice when the pairs outgrow the executors' state stores."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(score_increments(batch), batch_id)

    return (
        scorer_rows(values)
        .writeStream.option("checkpointLocation", table.checkpoint)
        .foreachBatch(write)
    )


# --- click log and sessions ----------------------------------------------------------------

SESSION_CANDIDATES = T.StructType(
    [
        *SESSIONS.fields,
        T.StructField("seen_at", T.TimestampType()),
        T.StructField("seen_id", T.LongType()),
    ]
)


# Batches between two closings of the days that are over: a quarter of an hour at the usual trigger.
CLOSE_EVERY = 180


def sessions_table(root: str) -> BatchTable:
    return BatchTable(root, "sessions", SESSION_CANDIDATES, first_per_session)


def click_log(root: str) -> DayLog:
    return DayLog(root, "click_log", CLICK_LOG)


def landing_tables(spark: SparkSession, root: str) -> None:
    """What `land` writes, empty where it is missing."""
    click_log(root).create(spark)
    sessions_table(root).create(spark)


def landed_log(spark: SparkSession, root: str) -> DataFrame:
    return click_log(root).read(spark)


def landed_sessions(spark: SparkSession, root: str) -> DataFrame:
    return sessions_table(root).read(spark).select(*SESSIONS.names)


def quarantine_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("reason string, value string, batch_id long").parquet(
        f"{root}/quarantine"
    )


def _write_batch_partitions(
    rows: DataFrame, batch_id: int, path: str, by: Sequence[str] = ()
) -> None:
    """Overwrite only this batch's partitions, below the partitions readers prune by."""
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by, "batch_id")
        .parquet(path)
    )


def land(values: DataFrame, root: str, close_every: int = CLOSE_EVERY) -> DataStreamWriter:
    """One query that lands the click log, the sessions and the rejects.

    A batch is parsed once and written three times; it is held between the writes, spilling
    to disk, and recomputed from the source if an executor is lost. Nothing is joined to what
    is already stored: sessions settle on their earliest row when read. Every `close_every`
    batches the days that are over are closed; all earlier batches are finished then.
    """
    sessions, log = sessions_table(root), click_log(root)
    landing_tables(values.sparkSession, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % close_every == 0:
            log.close(batch.sparkSession, batch_id - 1)
        batch.persist()
        try:
            if batch.isEmpty():
                return
            clicks = accepted(batch)
            log.write(log_rows(clicks), batch_id)
            sessions.write(first_per_session(session_candidates(clicks)), batch_id)
            _write_batch_partitions(quarantined(batch), batch_id, f"{root}/quarantine")
        finally:
            batch.unpersist()

    return (
        checked_messages(values)
        .writeStream.option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(write)
    )


# --- deduplicated feed ---------------------------------------------------------------------


def distinct_events(
    values: DataFrame, key: Sequence[str] = EVENT_KEY, delay: str | None = None
) -> DataFrame:
    """Each event once, however often it is delivered.

    Without a delay every key is remembered, and no event is ever too late. With one, state
    is dropped behind the watermark and so is any event, copy or not, that arrives later than
    that: right for a live display, never in front of the scorer or the click log. For a log use
    `land_distinct`, which bounds the state and loses nothing.
    """
    clicks = log_rows(accepted(checked_messages(values)))
    if delay is None:
        return clicks.dropDuplicates(list(key))
    return clicks.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(key))


def distinct_log(root: str) -> DayLog:
    return DayLog(root, "distinct_log", CLICK_LOG)


def land_distinct(
    values: DataFrame,
    root: str,
    key: Sequence[str] = EVENT_KEY,
    remember: str = "6 hours",
    ahead: str = "1 hour",
    close_every: int = CLOSE_EVERY,
) -> DataStreamWriter:
    """A log that holds each event once, with bounded state, and loses none.

    Copies are told apart in two tiers. Streaming state remembers a key for `remember` after it has
    arrived; its watermark runs on the time of arrival, behind which nothing can be late. An event
    old enough to have arrived before that is looked up in the log itself: only the days that such
    events of the batch belong to are read, without what this batch may have written before a
    failure. `ahead` is how far a producer's clock may be ahead of ours; `remember` is longer. Of
    copies the one that arrives first stays.
    """
    log = distinct_log(root)
    log.create(values.sparkSession)
    clicks = log_rows(accepted(checked_messages(values))).withColumn("arrived", F.current_timestamp())
    remembered = clicks.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(list(key))
    safe = F.col("arrived") - F.expr(f"INTERVAL {remember}") + F.expr(f"INTERVAL {ahead}")
    old = F.col("timestamp") < safe

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and batch_id % close_every == 0:
            log.close(spark, batch_id - 1)
        batch.persist()
        try:
            if batch.isEmpty():
                return
            late = batch.filter(old)
            # One value per day.
            days = [row.event_date for row in late.select("event_date").distinct().collect()]
            fresh = batch
            if days:
                stored = log.before_batch(spark, batch_id, days).select(*key)
                unseen = late.join(stored, list(key), "left_anti").select(batch.columns)
                fresh = batch.filter(~old).unionByName(unseen).persist()
            log.write(fresh, batch_id)
            fresh.unpersist()
        finally:
            batch.unpersist()

    return (
        remembered.writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(write)
    )


def append_files(rows: DataFrame, root: str, by: Sequence[str] = ()) -> DataStreamWriter:
    """Exactly-once append to a folder of Parquet files."""
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .option("path", f"{root}/rows")
    )
    return writer.partitionBy(*by) if by else writer
