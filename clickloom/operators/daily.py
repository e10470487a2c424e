"""Indicators of the newest day in the log.

"Today" is the UTC day of the newest event, never the clock. `event_date` is the stored
log's partition column, so the day filter prunes directories; callers that already know the
day (`sources.catalog.newest_day` reads it from the partition list) pass it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scoring import LIVE, score
from clickloom.functions.values import rounded_mean


COUNTED = ("event_date", "session_id", "user_id", "event_type")


def event_counts(log: DataFrame) -> DataFrame:
    """How often each user did what in a session on a day, as n_events: all that the indicators of a
    day need of its events. Counts of parts of a log, put together, are counts of the log; the
    functions below take either."""
    return log.groupBy(*COUNTED).agg(F.sum(_times(log)).alias("n_events"))


def _times(log: DataFrame) -> Column:
    return F.col("n_events") if "n_events" in log.columns else F.lit(1).cast("long")


def latest_day(log: DataFrame) -> Column:
    return log.agg(F.max("event_date")).scalar()


def on_day(log: DataFrame, day: Column | None = None) -> DataFrame:
    return log.filter(F.col("event_date") == (latest_day(log) if day is None else day))


def daily_kpis(log: DataFrame, day: Column | None = None) -> DataFrame:
    """Always one row; an empty log gives zeros and a null date."""
    return (
        on_day(log, day)
        .agg(
            F.coalesce(F.sum(_times(log)), F.lit(0)).alias("total_events"),
            F.countDistinct("user_id").alias("active_users"),
            F.coalesce(
                F.sum(F.when(F.col("event_type") == "purchase", _times(log))), F.lit(0)
            ).alias("purchases"),
            F.sum(score(LIVE) * _times(log)).alias("points"),
            F.max("event_date").alias("data_date"),
        )
        .select(
            "total_events",
            "active_users",
            "purchases",
            F.when(
                F.col("total_events") > 0, rounded_mean(F.col("points"), F.col("total_events"))
            )
            .otherwise(0.0)
            .alias("avg_score"),
            "data_date",
        )
    )


def _with_session(log: DataFrame, sessions: DataFrame, columns: list[str]) -> DataFrame:
    """Event counts per (session, user), joined to the session's attributes. Counting first
    leaves one row per session and user to shuffle, however busy a session is."""
    events = F.sum("n_events") if "n_events" in log.columns else F.count(F.lit(1))
    counts = log.groupBy("session_id", "user_id").agg(events.alias("n_events"))
    return counts.join(sessions.select("session_id", *columns), "session_id")


def active_countries(
    log: DataFrame, sessions: DataFrame, day: Column | None = None
) -> DataFrame:
    return (
        _with_session(on_day(log, day), sessions, ["country"])
        .groupBy("country")
        .agg(F.countDistinct("user_id").alias("active_users"))
        .orderBy(F.desc("active_users"), "country")
    )


def country_intensity(active: DataFrame, names: DataFrame) -> DataFrame:
    """Display name (the code where there is none) and share of the busiest country.

    `names` has (country, display_name).
    """
    top = active.agg(F.greatest(F.lit(1), F.coalesce(F.max("active_users"), F.lit(1)))).scalar()
    return (
        active.join(names, "country", "left")
        .select(
            "country",
            F.coalesce("display_name", "country").alias("display_name"),
            "active_users",
            (F.col("active_users") / top).alias("intensity"),
        )
        .orderBy(F.desc("active_users"), "country")
    )


def device_source(log: DataFrame, sessions: DataFrame, day: Column | None = None) -> DataFrame:
    return (
        _with_session(on_day(log, day), sessions, ["device", "source"])
        .groupBy("device", "source")
        .agg(F.countDistinct("user_id").alias("users"), F.sum("n_events").alias("events"))
        .orderBy(F.desc("events"), "device", "source")
    )


def traffic_breakdown(by_device_source: DataFrame) -> DataFrame:
    """Event totals by device and by source, from the small device-by-source result."""
    totals = by_device_source.groupingSets(
        [["device"], ["source"]], "device", "source"
    ).agg(F.sum("events").alias("value"), F.grouping("device").alias("over_source"))
    is_source = F.col("over_source") == 1
    return totals.select(
        F.when(is_source, "source").otherwise("device").alias("kind"),
        F.when(is_source, F.col("source")).otherwise(F.col("device")).alias("name"),
        "value",
    ).orderBy("kind", F.desc("value"), "name")


def top_users(log: DataFrame, customers: DataFrame, limit: int = 3) -> DataFrame:
    """Users by total live weight. Scores are summed before the join to names."""
    totals = (
        log.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.sum(score(LIVE)).alias("total_score"))
    )
    people = customers.select(F.col("customer_id").alias("user_id"), "name", "country")
    return (
        totals.join(people, "user_id")
        .select("user_id", "name", "country", "total_score")
        .orderBy(F.desc("total_score"), "user_id")
        .limit(limit)
    )
