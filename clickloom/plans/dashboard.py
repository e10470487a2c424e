"""Every dashboard and service query over one set of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.labels import COUNTRY_NAMES
from clickloom.operators import cleaning, daily, landing, live, recommend, sales, search
from clickloom.session import use_utc
from clickloom.sources import catalog, files, kafka
from clickloom.streaming import jobs


def country_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COUNTRY_NAMES.items()), "country string, display_name string")


@dataclass(frozen=True)
class Dashboard:
    log: DataFrame
    sessions: DataFrame
    scores: DataFrame
    products: DataFrame
    customers: DataFrame
    # The newest day and the events per day, where the caller knows them without reading the log.
    today: Column | None = None
    days: DataFrame | None = None

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str = "default") -> Dashboard:
        use_utc(spark)
        names = ("user_click_logs", "sessions", "user_recommendations", "products", "customers")
        tables = [catalog.table(spark, name, database) for name in names]
        return cls(*tables, today=catalog.newest_day(spark, database=database))

    @classmethod
    def from_landing(
        cls, spark: SparkSession, root: str, products: DataFrame, customers: DataFrame
    ) -> Dashboard:
        """Over what the streaming jobs under `root` have written so far. Days are looked up in the
        counts that the landing job keeps."""
        use_utc(spark)
        log = jobs.click_log(root)
        return cls(
            log.read(spark),
            jobs.landed_sessions(spark, root),
            jobs.running_scores_table(root).read(spark),
            products,
            customers,
            today=log.newest_day(spark),
            days=log.day_counts(spark),
        )

    def search(self, query: str, min_price: float = 0, max_price: float = 1e9) -> DataFrame:
        return search.product_search(self.products, query, min_price, max_price)

    def recommend_top(self, limit: int = 200) -> DataFrame:
        return recommend.recommend_top(self.scores, self.products, limit)

    def recommend(self, user_id: int, limit: int = 20) -> DataFrame:
        return recommend.recommend_user(self.scores, self.products, user_id, limit)

    def recommendation_bars(self, limit: int = 20) -> DataFrame:
        return recommend.score_share(recommend.recommend_all(self.scores, self.products, limit))

    def recent_events(self, limit: int = 30) -> DataFrame:
        return live.recent_events(live.recent_days(self.log, limit, self.days), limit)

    def live_feed(self, limit: int = 100) -> DataFrame:
        return live.live_feed(live.recent_distinct(self.log, limit, days=self.days), limit)

    def top_products(self, buffer: int = 200, limit: int = 8) -> DataFrame:
        recent = live.recent_distinct(self.log, buffer, days=self.days)
        return live.live_top_products(recent, self.products, buffer, limit)

    def daily_stats(self) -> DataFrame:
        return daily.daily_kpis(self.log, self.today)

    def sales_trend_filters(self) -> DataFrame:
        return sales.sales_filter_values(sales.sales_filters(self.log))

    def sales_trend(
        self,
        granularity: str = "month",
        year: int | None = None,
        month: int | None = None,
        day: int | None = None,
    ) -> DataFrame:
        trend = sales.sales_trend(self.log, granularity, year, month, day)
        return sales.sales_labels(trend, granularity)

    def top_categories(self) -> DataFrame:
        return sales.category_labels(sales.category_sales(self.log, self.products))

    def active_countries(self) -> DataFrame:
        return daily.active_countries(self.log, self.sessions, self.today)

    def country_map(self) -> DataFrame:
        names = country_names(self.log.sparkSession)
        return daily.country_intensity(self.active_countries(), names)

    def top_users(self, limit: int = 3) -> DataFrame:
        return daily.top_users(self.log, self.customers, limit)

    def device_stats(self) -> DataFrame:
        return daily.traffic_breakdown(
            daily.device_source(self.log, self.sessions, self.today)
        )


def log_events(
    entries: DataFrame,
    log_path: str | None = None,
    feed_path: str | None = None,
    servers: str | None = None,
) -> None:
    """Log events by hand, on one path. Where there is a feed they are published, and log and
    scores follow from the landed message; only without one are they appended to the log itself."""
    rows = landing.manual_events(entries)
    if not (servers or feed_path):
        if log_path is None:
            raise ValueError("name a feed to publish to or a log to append to")
        files.append_click_log(rows, log_path)
        return
    absent = {name: F.lit(None).cast("string") for name in cleaning.SESSION_FIELDS}
    absent["start_time"] = F.lit(None).cast("timestamp")
    values = cleaning.to_values(cleaning.event_messages(rows.withColumns(absent)))
    if servers:
        kafka.write_topic(values, servers)
    if feed_path:
        kafka.write_files(values, feed_path)
