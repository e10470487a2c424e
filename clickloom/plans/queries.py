"""The query catalogue over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.scoring import BATCH, LIVE, Weights, score
from clickloom.operators import (
    cleaning,
    daily,
    interactions,
    landing,
    live,
    quality,
    recommend,
    sales,
    search,
)
from clickloom.schemas import CLICK_LOG, PRIMARY_KEYS
from clickloom.session import streaming_session, use_utc
from clickloom.sources.canonical import Canonical, values_of
from clickloom.sources.staging import Staging
from clickloom.streaming import jobs, replay
from clickloom.streaming.lifecycle import drain
from clickloom.streaming.panels import Panels

Query = Callable[[SparkSession, str], DataFrame]

# Micro-batches a replay is spread over, and the day at which a log is split in two.
REPLAY_BATCHES = 3
SPLIT_DAY = "2024-01-16"
# How much later than its event a second copy is sent.
SECOND_DELIVERY = "12 days"


def output(frame: DataFrame) -> DataFrame:
    """Reader's types: timestamps without a zone, days as ISO text, doubles for decimals."""

    def column(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            return col.cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return col.cast("string").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return col.cast("double").alias(field.name)
        return col

    return frame.select(*[column(field) for field in frame.schema.fields])


def ids_as_text(frame: DataFrame) -> DataFrame:
    """Ids that may be absent as text: readers differ in how they take whole numbers with gaps."""
    ids = [name for name in ("event_id", "session_id") if name in frame.columns]
    return frame.withColumns({name: F.col(name).cast("string") for name in ids})


SEARCH_INDEX = "gram string, field string, product_id long"

CATALOGUE: dict[str, Query] = {}


def query(build: Callable[[Canonical], DataFrame]) -> Callable[[Canonical], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        use_utc(spark)
        return output(build(Canonical(spark, folder)))

    CATALOGUE[build.__name__] = run
    return build


# --- cleaning, landing, quality ------------------------------------------------------------


@query
def json_parse(data: Canonical) -> DataFrame:
    events = data.given("events").select("event_id", "props")
    parsed = cleaning.parse_values(events, T.StructType().add("k", "long"), "props")
    return parsed.filter(F.col("k").isNotNull()).select("event_id", F.col("k").alias("product_id"))


@query
def scorer_messages(data: Canonical) -> DataFrame:
    return cleaning.scorer_rows(values_of(data.delivered()))


def _scored(data: Canonical, weights: Weights) -> DataFrame:
    return data.click_log().select("event_id", "event_type", score(weights).alias("score"))


@query
def scored_live(data: Canonical) -> DataFrame:
    return _scored(data, LIVE)


@query
def scored_batch(data: Canonical) -> DataFrame:
    return _scored(data, BATCH)


@query
def click_events(data: Canonical) -> DataFrame:
    return cleaning.replay_order(cleaning.click_events(data.raw_events(), data.sessions()))


@query
def rejected_events(data: Canonical) -> DataFrame:
    return cleaning.rejected_events(data.raw_events(), data.recorded_sessions())


@query
def event_json(data: Canonical) -> DataFrame:
    """Messages written as JSON and read again."""
    clicks = cleaning.click_events(data.raw_events(), data.sessions())
    messages = cleaning.event_messages(clicks)
    return cleaning.parse_values(cleaning.to_values(messages), messages.schema)


@query
def sessions_first(data: Canonical) -> DataFrame:
    checked = cleaning.checked_messages(values_of(data.delivered()))
    return landing.sessions_first(cleaning.accepted(checked))


@query
def events_dedup(data: Canonical) -> DataFrame:
    return ids_as_text(landing.dedup_events(data.feed_log()))


@query
def quarantine(data: Canonical) -> DataFrame:
    return cleaning.quarantine_counts(cleaning.checked_messages(data.faulty_values()))


@query
def key_check(data: Canonical) -> DataFrame:
    tables = {
        "customers": data.customers(),
        "products": data.products(),
        "orders": data.orders(),
        "sessions": data.session_owners(),
        "user_click_logs": data.feed_log(),
        "user_recommendations": landing.score_increments(data.click_log()),
    }
    keyed = {name: (frame, PRIMARY_KEYS[name]) for name, frame in tables.items()}
    keyed["order_items"] = (data.order_items(), ["order_id", "product_id"])
    return quality.key_checks(keyed)


@query
def load_audit(data: Canonical) -> DataFrame:
    return quality.load_audit(
        {
            "customers": data.customers(),
            "products": data.products(),
            "orders": data.orders(),
            "order_items": data.order_items(),
            "sessions": data.session_owners(),
            "events": data.click_log(),
        }
    )


# --- interactions and recommendations ------------------------------------------------------


def _interactions(data: Canonical) -> DataFrame:
    return interactions.interactions(
        data.click_log(), data.session_owners(), data.orders(), data.order_items()
    )


def _stored_interactions(data: Canonical, staging: Staging) -> DataFrame:
    return staging.put(_interactions(data), "interactions")


def _scores(data: Canonical) -> DataFrame:
    return landing.score_increments(data.click_log())


@query
def interactions_view(data: Canonical) -> DataFrame:
    return interactions.sum_pairs(interactions.scored_views(data.click_log(), data.session_owners()))


@query
def order_interactions(data: Canonical) -> DataFrame:
    return interactions.order_signals(data.orders(), data.order_items())


@query
def user_product_interactions(data: Canonical) -> DataFrame:
    return _interactions(data)


@query
def product_popularity(data: Canonical) -> DataFrame:
    return interactions.product_popularity(_interactions(data))


@query
def top_products(data: Canonical) -> DataFrame:
    return interactions.top_products(interactions.product_popularity(_interactions(data)))


@query
def candidates_unseen(data: Canonical) -> DataFrame:
    return recommend.unseen_counts(_stored_interactions(data, Staging(data.spark)))


@query
def recommend_unseen(data: Canonical) -> DataFrame:
    staging = Staging(data.spark)
    return recommend.recommend_unseen(_stored_interactions(data, staging), staging)


@query
def als_input(data: Canonical) -> DataFrame:
    return interactions.als_input(_interactions(data))


@query
def user_scores(data: Canonical) -> DataFrame:
    return _scores(data)


@query
def upsert_scores(data: Canonical) -> DataFrame:
    log = data.click_log()
    day = F.lit(SPLIT_DAY).cast("date")
    stored = landing.score_increments(log.filter(F.col("event_date") < day))
    arriving = landing.score_increments(log.filter(F.col("event_date") >= day))
    return landing.merge_scores(stored, arriving)


@query
def recommend_top(data: Canonical) -> DataFrame:
    return recommend.recommend_top(_scores(data), data.products())


@query
def recommend_user(data: Canonical) -> DataFrame:
    return recommend.recommend_user(_scores(data), data.products(), user_id=10)


@query
def recommend_all(data: Canonical) -> DataFrame:
    return recommend.recommend_all(_scores(data), data.products())


@query
def score_share(data: Canonical) -> DataFrame:
    return recommend.score_share(recommend.recommend_all(_scores(data), data.products()))


@query
def product_search(data: Canonical) -> DataFrame:
    return search.product_search(data.products(), "ring", 900, 950)


@query
def product_search_indexed(data: Canonical) -> DataFrame:
    path = Staging(data.spark).path("search-index")
    search.write_search_index(data.products(), path)
    index = data.spark.read.schema(SEARCH_INDEX).parquet(path)
    return search.indexed_search(data.products(), index, "ring", 900, 950)


# --- live feed -----------------------------------------------------------------------------


@query
def recent_events(data: Canonical) -> DataFrame:
    return live.recent_events(live.recent_days(data.feed_log(), 30), 30)


@query
def live_feed(data: Canonical) -> DataFrame:
    return ids_as_text(live.live_feed(live.recent_distinct(data.feed_log(), 100), 100))


@query
def live_top_products(data: Canonical) -> DataFrame:
    log = live.recent_distinct(data.feed_log(), 200)
    return live.live_top_products(log, data.products(), buffer=200)


# --- daily indicators and sales ------------------------------------------------------------


@query
def daily_kpis(data: Canonical) -> DataFrame:
    return daily.daily_kpis(data.click_log())


@query
def active_countries(data: Canonical) -> DataFrame:
    return daily.active_countries(data.click_log(), data.sessions())


@query
def country_intensity(data: Canonical) -> DataFrame:
    active = daily.active_countries(data.click_log(), data.sessions())
    return daily.country_intensity(active, data.country_names())


@query
def device_source(data: Canonical) -> DataFrame:
    return daily.device_source(data.click_log(), data.session_origins())


@query
def traffic_breakdown(data: Canonical) -> DataFrame:
    return daily.traffic_breakdown(daily.device_source(data.click_log(), data.session_origins()))


@query
def top_users(data: Canonical) -> DataFrame:
    return daily.top_users(data.click_log(), data.customers())


@query
def sales_filters(data: Canonical) -> DataFrame:
    return sales.sales_filters(data.click_log())


@query
def sales_filter_values(data: Canonical) -> DataFrame:
    return sales.sales_filter_values(sales.sales_filters(data.click_log()))


@query
def sales_trend_hour(data: Canonical) -> DataFrame:
    return sales.sales_trend(data.click_log(), "hour", 2024, 1, 30)


@query
def sales_trend_day(data: Canonical) -> DataFrame:
    return sales.sales_trend(data.click_log(), "day", 2024, 1)


@query
def sales_trend_month(data: Canonical) -> DataFrame:
    return sales.sales_trend(data.click_log(), "month", 2024)


@query
def sales_trend_year(data: Canonical) -> DataFrame:
    return sales.sales_trend(data.click_log(), "year")


@query
def sales_labels(data: Canonical) -> DataFrame:
    return sales.sales_labels(sales.sales_trend(data.click_log(), "day", 2024, 1), "day")


@query
def category_sales(data: Canonical) -> DataFrame:
    return sales.category_sales(data.click_log(), data.products())


@query
def category_labels(data: Canonical) -> DataFrame:
    return sales.category_labels(sales.category_sales(data.click_log(), data.products()))


# --- streaming -----------------------------------------------------------------------------


def _replayed(data: Canonical, staging: Staging, clicks: DataFrame, by: str = "timestamp") -> DataFrame:
    files = max(REPLAY_BATCHES, data.spark.sparkContext.defaultParallelism)
    folder = staging.path("feed")
    replay.publish(clicks, folder, files, by)
    return replay.replay(streaming_session(data.spark), folder, files, REPLAY_BATCHES)


@query
def stream_user_scores(data: Canonical) -> DataFrame:
    staging = Staging(data.spark)
    table = jobs.running_scores_table(staging.path("jobs")).create(data.spark)
    drain(jobs.running_scores(_replayed(data, staging, data.delivered()), table))
    return table.read(data.spark)


@query
def stream_score_increments(data: Canonical) -> DataFrame:
    staging = Staging(data.spark)
    table = jobs.score_increments_table(staging.path("jobs")).create(data.spark)
    drain(jobs.incremental_scores(_replayed(data, staging, data.delivered()), table))
    return table.read(data.spark)


def _landed(data: Canonical) -> str:
    staging = Staging(data.spark)
    root = staging.path("jobs")
    drain(jobs.land(_replayed(data, staging, data.delivered()), root))
    return root


@query
def stream_click_log(data: Canonical) -> DataFrame:
    return ids_as_text(jobs.landed_log(data.spark, _landed(data)))


@query
def stream_sessions(data: Canonical) -> DataFrame:
    return jobs.landed_sessions(data.spark, _landed(data))


@query
def stream_dedup(data: Canonical) -> DataFrame:
    """Every event delivered twice, the second time days after the first."""
    staging = Staging(data.spark)
    log = data.delivered()
    sent = F.col("timestamp") + F.expr(f"INTERVAL {SECOND_DELIVERY}")
    twice = log.withColumn("sent", F.col("timestamp")).unionByName(log.withColumn("sent", sent))
    root = staging.path("jobs")
    drain(jobs.land_distinct(_replayed(data, staging, twice, "sent"), root))
    return ids_as_text(jobs.distinct_log(root).read(data.spark))


# --- panels kept up to date by batches -----------------------------------------------------


def _panels(data: Canonical, log: DataFrame, name: str) -> Panels:
    """A panel table after some batches that mix all days, the first of them closed before the last."""
    panels = Panels(Staging(data.spark).path("panels")).create(data.spark, name)
    number = F.pmod(F.xxhash64("user_id", "product_id", "timestamp", "event_id"), F.lit(REPLAY_BATCHES))
    for batch_id in range(REPLAY_BATCHES):
        if batch_id == REPLAY_BATCHES - 1:
            panels.close(data.spark, batch_id - 1, name)
        panels.write(log.filter(number == batch_id), batch_id, name)
    return panels


@query
def panel_daily_kpis(data: Canonical) -> DataFrame:
    return _panels(data, data.click_log(), "counts").daily_kpis(data.spark)


@query
def panel_device_source(data: Canonical) -> DataFrame:
    return _panels(data, data.click_log(), "counts").device_source(data.spark, data.session_origins())


@query
def panel_active_countries(data: Canonical) -> DataFrame:
    return _panels(data, data.click_log(), "counts").active_countries(data.spark, data.sessions())


@query
def panel_sales_trend_day(data: Canonical) -> DataFrame:
    return _panels(data, data.click_log(), "sales").sales_trend(data.spark, "day", 2024, 1)


@query
def panel_top_products(data: Canonical) -> DataFrame:
    return _panels(data, data.feed_log(), "newest").live_top_products(data.spark, data.products())
