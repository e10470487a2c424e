"""Sales over time and by category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.labels import money_label, money_tick
from clickloom.functions.periods import period_label, period_start, scope_filters, scope_range
from clickloom.functions.values import money, money_out


def purchases(log: DataFrame) -> DataFrame:
    return log.filter((F.col("event_type") == "purchase") & F.col("amount_usd").isNotNull())


def session_sales(sales: DataFrame) -> DataFrame:
    """One sale per session: its last purchase time and its largest amount."""
    return sales.groupBy("session_id").agg(
        F.max("timestamp").alias("sale_time"), F.max(money(F.col("amount_usd"))).alias("amount_usd")
    )


def sale_facts(log: DataFrame) -> DataFrame:
    """One row per session and day with a purchase: the day's last purchase time and largest amount.
    A session's sale within any scope of whole days follows from them, and moves to a later day when
    a purchase arrives there. Facts read like a log of purchases, and facts of facts are facts."""
    return (
        purchases(log)
        .groupBy("event_date", "session_id")
        .agg(F.max("timestamp").alias("timestamp"), F.max("amount_usd").alias("amount_usd"))
        .select("event_date", "session_id", F.lit("purchase").alias("event_type"), "timestamp", "amount_usd")
    )


def sales_trend(
    log: DataFrame,
    granularity: str = "month",
    year: int | None = None,
    month: int | None = None,
    day: int | None = None,
) -> DataFrame:
    """Orders and revenue per period, sessions counted once within the chosen scope.

    The scope is applied before a session is reduced to one sale, so a session that crosses
    its edge counts at its last purchase inside it.
    """
    scope = scope_filters(F.col("event_date"), granularity, year, month, day)
    scope += scope_range(F.col("timestamp"), granularity, year, month, day)
    scoped = reduce(DataFrame.filter, scope, purchases(log))
    return (
        session_sales(scoped)
        .groupBy(period_start(F.col("sale_time"), granularity).alias("period"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            money_out(F.sum("amount_usd")).alias("revenue"),
        )
        .orderBy("period")
    )


def sales_filters(log: DataFrame) -> DataFrame:
    """Days that have sales, as (year, month, day). Reduced to distinct days first."""
    day = F.col("event_date")
    return (
        purchases(log)
        .select("event_date")
        .distinct()
        .select(
            F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day")
        )
        .orderBy("year", "month", "day")
    )


def sales_filter_values(filters: DataFrame) -> DataFrame:
    """The values each selector offers, as (kind, value)."""
    long_form = filters.unpivot([], ["year", "month", "day"], "kind", "value")
    return long_form.distinct().orderBy("kind", "value")


def sales_labels(trend: DataFrame, granularity: str) -> DataFrame:
    """A trend with its display texts."""
    return trend.select(
        "period",
        "order_count",
        "revenue",
        period_label(F.col("period"), granularity).alias("period_label"),
        money_tick(F.col("revenue"), from_exactly_1000=True).alias("revenue_tick"),
        money_label(F.col("revenue")).alias("revenue_label"),
    ).orderBy("period")


def category_sales(log: DataFrame, products: DataFrame) -> DataFrame:
    """Sessions, events and revenue per category. Purchases are summed as they are; unlike
    the trend, a session is not reduced to one sale."""
    amount = F.when(F.col("event_type") == "purchase", money(F.col("amount_usd")))
    # Counted before the join: one row per product and session, however busy a product is.
    counted = log.groupBy("product_id", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount_usd")
    )
    return (
        counted.join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(
            F.countDistinct("session_id").alias("total_sessions"),
            F.sum("n").alias("total_events"),
            money_out(F.coalesce(F.sum("amount_usd"), F.lit(0))).alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def category_labels(categories: DataFrame) -> DataFrame:
    return categories.withColumns(
        {
            "revenue_tick": money_tick(F.col("total_revenue"), from_exactly_1000=False),
            "revenue_label": money_label(F.col("total_revenue")),
        }
    )
