"""User-product interaction scores from events and orders (batch weights)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scoring import BATCH, ORDER_SIGNAL, score

PAIR = ("user_id", "product_id")


def scored_views(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Weighted events with the user of their session, summed per session and product before
    the join: a session that holds much of the log then has one row per product."""
    per_session = (
        events.filter(F.col("product_id").isNotNull() & F.col("session_id").isNotNull())
        .groupBy("session_id", "product_id")
        .agg(F.sum(score(BATCH)).alias("interaction_score"))
    )
    owners = sessions.select("session_id", F.col("customer_id").alias("user_id"))
    joined = per_session.join(owners.filter(F.col("user_id").isNotNull()), "session_id")
    return joined.select(*PAIR, "interaction_score")


def order_signals(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """One row per order line; quantity does not count.

    Orders without lines carry no product, so the join is inner: a null product would
    otherwise become the most popular one.
    """
    buyers = orders.select("order_id", F.col("customer_id").alias("user_id"))
    joined = buyers.join(order_items.select("order_id", "product_id"), "order_id")
    known = joined.filter(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    return known.select(*PAIR, F.lit(ORDER_SIGNAL).cast("long").alias("interaction_score"))


def sum_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PAIR).agg(F.sum("interaction_score").alias("interaction_score"))


def interactions(
    events: DataFrame, sessions: DataFrame, orders: DataFrame, order_items: DataFrame
) -> DataFrame:
    """Views and orders in one sum: the two row sets are united before pairs are shuffled, so
    that happens once."""
    rows = scored_views(events, sessions).unionByName(order_signals(orders, order_items))
    return sum_pairs(rows)


def product_popularity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("product_id").agg(F.sum("interaction_score").alias("popularity_score"))


def top_products(popularity: DataFrame, limit: int = 10) -> DataFrame:
    return popularity.orderBy(F.desc("popularity_score"), "product_id").limit(limit)


def als_input(pairs: DataFrame) -> DataFrame:
    """The matrix form that `pyspark.ml.recommendation.ALS` takes."""
    return pairs.select(
        F.col("user_id").cast("int").alias("user_id"),
        F.col("product_id").cast("int").alias("product_id"),
        F.col("interaction_score").cast("float").alias("interaction_score"),
    )
