"""The newest events, and what they say about products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.labels import (
    clock,
    day_label,
    event_label,
    iso,
    product_fallback,
    score_label,
)
from clickloom.functions.periods import utc_day
from clickloom.functions.scoring import LIVE, score
from clickloom.operators.landing import EVENT_KEY, dedup_events

def _day_counts(log: DataFrame, days: DataFrame | None) -> DataFrame:
    """event_date and n, one row per day: as handed in, else counted from the partition column."""
    if days is not None:
        return days.select("event_date", "n")
    return log.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


def recent_days(log: DataFrame, limit: int, days: DataFrame | None = None) -> DataFrame:
    """Only the newest days that together hold `limit` events; the rest of a log partitioned by
    day is not read. Exact: the days come from the counts per day, which a caller that keeps them
    hands in as `days` (event_date, n). Events without a time are older than all others and stay
    where there are too few timed ones."""
    # One row per day.
    newer = Window.orderBy(F.desc_nulls_last("event_date")).rowsBetween(Window.unboundedPreceding, -1)
    needed = _day_counts(log, days).select(
        "event_date", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("newer")
    ).filter(F.col("newer") < limit)
    untimed = F.coalesce(F.bool_or(F.col("event_date").isNull()), F.lit(False))
    # Both values in one subquery, so that the days are counted once.
    bounds = needed.agg(F.struct(F.min("event_date").alias("first"), untimed.alias("untimed"))).scalar()
    day = F.col("event_date")
    return log.filter((day >= bounds.getField("first")) | (day.isNull() & bounds.getField("untimed")))


def recent_distinct(
    log: DataFrame, limit: int, key: Sequence[str] = EVENT_KEY, days: DataFrame | None = None
) -> DataFrame:
    """As `recent_days`, for a log with copies: only events as new as the `limit`-th distinct
    one. The days are listed once, one row each; the newest days that could hold enough are
    looked at first, then twice as many, until they hold enough distinct events. The driver sees
    the days, and one count and one time per step. Only a log that has too few of them altogether
    is returned whole, untimed events included. Copies share their time because it is in the key;
    with another key there is no such bound and the log is returned whole."""
    if "timestamp" not in key:
        return log
    counts = _day_counts(log, days).filter(F.col("event_date").isNotNull())
    newest = sorted(((row.event_date, row.n) for row in counts.collect()), reverse=True)
    taken, events = 0, 0
    while taken < len(newest):
        # Days with fewer events than asked for need not be tried.
        wanted = max(2 * taken, 1)
        while taken < len(newest) and (taken < wanted or events < limit):
            events += newest[taken][1]
            taken += 1
        scoped = log.filter(F.col("event_date") >= F.lit(newest[taken - 1][0]))
        top = scoped.select(*key).distinct().orderBy(F.desc("timestamp")).limit(limit)
        distinct, bound = top.agg(
            F.count(F.lit(1)), F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ).first()
        if distinct >= limit:
            time = F.lit(bound).cast("timestamp")
            return log.filter((F.col("event_date") >= utc_day(time)) & (F.col("timestamp") >= time))
    return log


def newest_distinct(events: DataFrame, size: int) -> DataFrame:
    """Each of the newest `size` distinct events once, with all that share the last one's time, and
    events without a time where there are too few others. What is left out here can never be among
    the newest of a larger log, so results of parts, put together and reduced again, are the result
    of the whole."""
    once = dedup_events(events)
    top = once.filter(F.col("timestamp").isNotNull()).select("timestamp").orderBy(F.desc("timestamp")).limit(size)
    bound = top.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("last"))).scalar()
    return once.filter((bound.getField("n") < size) | (F.col("timestamp") >= bound.getField("last")))


def latest(events: DataFrame, limit: int) -> DataFrame:
    """The newest rows; ties are broken by the columns that tell copies apart."""
    return events.orderBy(
        F.desc_nulls_last("timestamp"), F.desc_nulls_last("event_id"),
        "event_type", "session_id", "user_id", "product_id",
    ).limit(limit)


def recent_events(log: DataFrame, limit: int = 30) -> DataFrame:
    return latest(log, limit).select(
        "user_id", "product_id", "event_type", iso(F.col("timestamp")).alias("timestamp")
    )


def live_feed(log: DataFrame, limit: int = 100, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """The newest distinct events with their display texts."""
    return latest(dedup_events(log, key), limit).select(
        "event_id",
        "user_id",
        "product_id",
        "event_type",
        "timestamp",
        clock(F.col("timestamp")).alias("time_label"),
        day_label(F.col("timestamp")).alias("date_label"),
        event_label(F.col("user_id"), F.col("product_id")).alias("event_label"),
        score_label(score(LIVE)).alias("score_label"),
    )


def live_top_products(
    log: DataFrame, products: DataFrame, buffer: int = 200, limit: int = 8
) -> DataFrame:
    """Products by live weight within the newest `buffer` distinct events."""
    totals = latest(dedup_events(log), buffer).groupBy("product_id").agg(F.sum(score(LIVE)).alias("score"))
    best = totals.orderBy(F.desc("score"), "product_id").limit(limit)
    names = products.select("product_id", "name")
    return (
        best.join(names, "product_id", "left")
        .select(
            "product_id",
            F.coalesce("name", product_fallback(F.col("product_id"))).alias("name"),
            "score",
        )
        .orderBy(F.desc("score"), "product_id")
    )
