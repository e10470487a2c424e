"""Sessions, duplicate events and score increments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scoring import LIVE, Weights, score
from clickloom.schemas import CLICK_LOG, SESSIONS

EVENT_KEY = ("user_id", "product_id", "timestamp")


def session_candidates(clicks: DataFrame) -> DataFrame:
    """One possible session row per event, with the order that decides which one is first."""
    return clicks.filter(F.col("session_id").isNotNull()).select(
        "session_id",
        F.col("user_id").alias("customer_id"),
        "start_time",
        "device",
        "source",
        "country",
        F.col("timestamp").alias("seen_at"),
        F.col("event_id").alias("seen_id"),
    )


def first_per_session(candidates: DataFrame) -> DataFrame:
    """The earliest (seen_at, seen_id) wins. Each task reduces its own rows first, so a
    session that fills a third of the log sends one row per task. The order columns stay, so
    that partial results can be reduced again."""
    values = [name for name in candidates.columns if name != "session_id"]
    first = F.min_by(F.struct(*values), F.struct("seen_at", "seen_id"))
    return candidates.groupBy("session_id").agg(first.alias("row")).select("session_id", "row.*")


def sessions_first(clicks: DataFrame) -> DataFrame:
    """One row per session: the first one written."""
    return first_per_session(session_candidates(clicks)).select(*SESSIONS.names)


def dedup_events(events: DataFrame, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """One row per key: the lowest event_id, rows without one last, then type and session.
    Copies are reduced within each task before the shuffle, so an event delivered over and over
    costs one row per task."""
    values = [name for name in events.columns if name not in key]
    order = [F.col("event_id").isNull().alias("unnumbered")]
    order += [F.col(name) for name in ("event_id", "event_type", "session_id") if name in values]
    first = F.min_by(F.struct(*values), F.struct(*order))
    return (
        events.groupBy(*key)
        .agg(first.alias("row"))
        .select(*key, "row.*")
        .select(*events.columns)
    )


def manual_events(entries: DataFrame) -> DataFrame:
    """Click-log rows for events logged by hand: user, product and type (a page view unless
    stated), now unless timed, no session and no amounts."""
    have = set(entries.columns)
    defaults = {
        "event_type": F.lit("page_view"),
        "timestamp": F.current_timestamp(),
    }

    def column(field):
        value = F.col(field.name) if field.name in have else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        return value.cast(field.dataType).alias(field.name)

    fields = [f for f in CLICK_LOG.fields if f.name != "event_date"]
    rows = entries.select(*[column(field) for field in fields])
    return rows.withColumn("event_date", F.to_date("timestamp")).select(*CLICK_LOG.names)


def score_increments(log: DataFrame, weights: Weights = LIVE) -> DataFrame:
    """Sum of live weights per (user, product); rows without either are not scored."""
    scored = log.filter(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    return scored.groupBy("user_id", "product_id").agg(
        F.sum(score(weights)).alias("popularity_score")
    )


def merge_scores(stored: DataFrame, increments: DataFrame) -> DataFrame:
    """Additive upsert: a pair gains its increment, a new pair is inserted."""
    return (
        stored.unionByName(increments)
        .groupBy("user_id", "product_id")
        .agg(F.sum("popularity_score").alias("popularity_score"))
    )
