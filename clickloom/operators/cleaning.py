"""Raw events and messages to clean events, and back to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.periods import utc_day
from clickloom.functions.scoring import LIVE, Weights, score
from clickloom.functions.values import id_or_null, number_or_null, text_or
from clickloom.schemas import CLICK_LOG, MONEY, RATE, RAW_MESSAGE, SCORER_MESSAGE

OPTIONAL_NUMBERS = ("qty", "cart_size", "amount_usd", "discount_pct")
DEFAULT_EVENT_TYPE = "page_view"
SESSION_FIELDS = ("device", "source", "country")


def click_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events with their session's user and attributes, cleaned.

    Events without a session, user or product are dropped (`rejected_events` counts them).
    An inner join says so up front: null session ids never reach the shuffle.
    """
    session = sessions.select("session_id", "customer_id", "start_time", *SESSION_FIELDS)
    joined = events.join(session, "session_id", "inner")
    kept = joined.na.drop(subset=["product_id", "customer_id"])
    numbers = [number_or_null(F.col(name)).alias(name) for name in OPTIONAL_NUMBERS]
    identity = [F.col("event_id")] if "event_id" in events.columns else []
    return kept.select(
        *identity,
        F.col("customer_id").cast("long").alias("user_id"),
        F.col("product_id").cast("long").alias("product_id"),
        F.trim(F.coalesce("event_type", F.lit(DEFAULT_EVENT_TYPE))).alias("event_type"),
        "timestamp",
        *numbers,
        F.col("session_id").cast("long").alias("session_id"),
        *SESSION_FIELDS,
        "start_time",
    )


def replay_order(events: DataFrame) -> DataFrame:
    """Event-time order for a replay: a range-partitioned sort, no single task sees it all."""
    return events.orderBy("timestamp", "event_id")


def rejected_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """What `click_events` drops, as (reason, n_events).

    Events are first counted per session, so the join carries one row per session and
    product state however often the session (or a missing one) occurs.
    """
    per_session = events.groupBy(
        "session_id", F.col("product_id").isNull().alias("no_product")
    ).agg(F.count(F.lit(1)).alias("n"))
    users = sessions.select("session_id", "customer_id")
    reason = F.when(F.col("customer_id").isNull(), "missing_user").when(
        F.col("no_product"), "missing_product"
    )
    return (
        per_session.join(users, "session_id", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.sum("n").alias("n_events"))
    )


def event_messages(clicks: DataFrame, weights: Weights = LIVE) -> DataFrame:
    """The fields of a published message, times as text."""
    time_text = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    identity = [F.col("event_id")] if "event_id" in clicks.columns else []
    return clicks.select(
        *identity,
        "user_id",
        "product_id",
        "event_type",
        score(weights).alias("score"),
        F.date_format("timestamp", time_text).alias("timestamp"),
        *[F.col(name).cast("double").alias(name) for name in OPTIONAL_NUMBERS],
        "session_id",
        *SESSION_FIELDS,
        F.date_format("start_time", time_text).alias("start_time"),
    )


def to_values(messages: DataFrame) -> DataFrame:
    """One JSON text per row; absent values are written as nulls."""
    whole = F.struct(*[F.col(f"`{name}`") for name in messages.columns])
    return messages.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def parse_values(values: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """JSON text or bytes to typed columns, next to the other columns. Malformed text gives
    nulls throughout; a field of the wrong type gives a null for that field alone."""
    others = [name for name in values.columns if name != column]
    return values.select(*others, _parsed(F.col(column).cast("string"), schema))


def _parsed(text: Column, schema: T.StructType, options: dict[str, str] | None = None) -> Column:
    """The parsed fields as columns. They come out of a generator because conditions on them
    would otherwise be pushed into the scan with one more parse of the text for each."""
    return F.inline(F.array(F.from_json(text, schema, options or {})))


def scorer_rows(values: DataFrame) -> DataFrame:
    """The scorer's three fields, rows without a user or product dropped."""
    parsed = parse_values(values, SCORER_MESSAGE)
    return parsed.filter(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())


def _given_number(text: Column) -> Column:
    """Null where the text is empty or says that there is no number."""
    return F.when(~F.lower(text).isin("", "nan"), text)


def _reject_reason() -> Column:
    """First failing check; null for a good message."""

    def bad_id(name: str) -> Column:
        return F.col(name).isNotNull() & id_or_null(F.col(name)).isNull()

    checks = {"bad_json": F.col("whole").isNotNull() | F.col("value").isNull()}
    for name in ("user_id", "product_id"):
        checks[f"missing_{name}"] = F.col(name).isNull()
        checks[f"bad_{name}"] = bad_id(name)
    checks["missing_event_type"] = F.col("event_type").isNull()
    checks["bad_session_id"] = bad_id("session_id")
    for name in ("timestamp", "start_time"):
        given = text_or(F.col(name), F.lit(None))
        checks[f"bad_{name}"] = given.isNotNull() & given.try_cast("timestamp").isNull()
    for name in OPTIONAL_NUMBERS:
        given = _given_number(F.col(name))
        kind = RATE if name == "discount_pct" else MONEY
        checks[f"bad_{name}"] = given.isNotNull() & given.try_cast(kind).isNull()
    chain = F
    for reason, failed in checks.items():
        chain = chain.when(failed, F.lit(reason))
    return chain.otherwise(F.lit(None).cast("string"))


def checked_messages(values: DataFrame) -> DataFrame:
    """Every message with its text, parsed fields (still untrusted text), `reason` and the time
    it was read. In a stream that clock is part of the plan, so a repeated batch reads it alike."""
    schema = T.StructType([*RAW_MESSAGE.fields, T.StructField("whole", T.StringType())])
    options = {"columnNameOfCorruptRecord": "whole"}
    text = F.col("value").cast("string")
    parsed = values.select(text.alias("value"), _parsed(text, schema, options))
    checked = parsed.withColumn("reason", _reject_reason()).drop("whole")
    return checked.withColumn("received_at", F.current_timestamp())


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).select("reason", "value")


def quarantine_counts(checked: DataFrame) -> DataFrame:
    return quarantined(checked).groupBy("reason").agg(F.count(F.lit(1)).alias("n_events"))


def accepted(checked: DataFrame) -> DataFrame:
    """Good messages as typed click-log rows with their session attributes.

    A missing event time means the time of receipt; a missing session start means the event time.
    """
    timestamp = F.coalesce(F.col("timestamp").try_cast("timestamp"), F.col("received_at"))
    good = checked.filter(F.col("reason").isNull()).withColumn("timestamp", timestamp)
    start = text_or(F.col("start_time"), F.lit(None)).try_cast("timestamp")
    return good.select(
        id_or_null(F.col("event_id")).alias("event_id"),
        id_or_null(F.col("user_id")).alias("user_id"),
        id_or_null(F.col("product_id")).alias("product_id"),
        F.trim("event_type").alias("event_type"),
        "timestamp",
        id_or_null(F.col("session_id")).alias("session_id"),
        *[_given_number(F.col(name)).try_cast(MONEY).alias(name) for name in OPTIONAL_NUMBERS[:3]],
        _given_number(F.col("discount_pct")).try_cast(RATE).alias("discount_pct"),
        utc_day(F.col("timestamp")).alias("event_date"),
        *[text_or(F.col(name), F.lit("")).alias(name) for name in SESSION_FIELDS],
        F.coalesce(start, "timestamp").alias("start_time"),
    )


def log_rows(clicks: DataFrame) -> DataFrame:
    """The click log's own columns."""
    return clicks.select(*CLICK_LOG.names)
