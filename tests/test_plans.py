"""What the physical plans must show, and how operators take hot keys."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import cleaning, daily, interactions, landing, live, recommend, sales
from clickloom.schemas import CLICK_LOG
from clickloom.sources.files import append_click_log
from clickloom.sources.staging import Staging
from plan_text import plan_of
from frames import rows


@pytest.fixture(scope="module")
def generated(spark):
    """Ten days of clicks; user, product and session 0 hold a third of them."""
    hot = F.col("id") % 3 == 0
    kinds = F.array(*[F.lit(k) for k in ("page_view", "add_to_cart", "checkout", "purchase")])
    return (
        spark.range(60_000)
        .select(
            F.col("id").alias("event_id"),
            F.when(hot, 0).otherwise(F.col("id") % 977).alias("user_id"),
            F.when(hot, F.col("id") % 1501).otherwise(F.col("id") % 211).alias("product_id"),
            F.element_at(kinds, (F.col("id") % 4 + 1).cast("int")).alias("event_type"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 14).alias("timestamp"),
            F.when(hot, 0).otherwise(F.col("id") % 5003).alias("session_id"),
            *[F.lit(None).cast("decimal(18,2)").alias(c) for c in ("qty", "cart_size")],
            F.when(F.col("id") % 4 == 3, F.lit("1.25")).cast("decimal(18,2)").alias("amount_usd"),
            F.lit(None).cast("decimal(9,4)").alias("discount_pct"),
        )
        .withColumn("event_date", F.to_date("timestamp"))
        .select(*CLICK_LOG.names)
    )


@pytest.fixture(scope="module")
def stored(spark, generated, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "click_log")
    append_click_log(generated, path)
    return spark.read.schema(CLICK_LOG).parquet(path)


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.range(5003).select(
        F.col("id").alias("session_id"),
        (F.col("id") % 977).alias("customer_id"),
        F.lit("2024-01-01").cast("timestamp").alias("start_time"),
        F.lit("mobile").alias("device"),
        F.lit("paid").alias("source"),
        (F.col("id") % 5).cast("string").alias("country"),
    )


def read_columns(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def files_read(frame) -> int:
    """Files the scans of an executed frame opened, from the scans' own metric."""

    def count(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return count(node.executedPlan())
        if "QueryStage" in name:
            return count(node.plan())
        if name.startswith("Scan parquet"):
            return node.metrics().apply("numFiles").value()
        children = node.children()
        return sum(count(children.apply(i)) for i in range(children.size()))

    return count(frame._jdf.queryExecution().executedPlan())


def test_the_log_is_laid_out_by_day(stored):
    assert stored.select("event_date").distinct().count() == 10


def test_the_newest_day_prunes_partitions(stored):
    found = daily.daily_kpis(stored)
    plan = plan_of(found)
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ = Subquery", plan)
    scanned = [c for c in read_columns(plan) if "user_id" in c]
    assert scanned == ["user_id:bigint,event_type:string"]
    by_hand = stored.filter("event_date = '2024-01-10'")
    assert rows(found, "total_events") == [(by_hand.count(),)]
    assert 0 < files_read(found) < len(stored.inputFiles())


def test_a_sales_scope_prunes_partitions(stored):
    trend = sales.sales_trend(stored, "hour", 2024, 1, 3)
    plan = plan_of(trend)
    assert "dayofmonth(event_date" in re.search(r"PartitionFilters: \[.*?\], Pushed", plan)[0]
    assert "EqualTo(event_type,purchase)" in plan
    assert "GreaterThanOrEqual(timestamp,2024-01-03" in plan
    assert 0 < files_read(trend) < len(stored.inputFiles())


def test_recent_events_read_only_the_newest_days(stored):
    found = live.recent_events(live.recent_days(stored, 30), 30)
    plan = plan_of(found)
    assert "TakeOrderedAndProject" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ >= Subquery", plan)
    assert rows(found) == rows(live.recent_events(stored, 30))


def test_distinct_recent_events_read_only_the_newest_day(stored):
    found = live.live_feed(live.recent_distinct(stored, 100))
    plan = plan_of(found)
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ >= 2024-01-10", plan)
    assert rows(found) == rows(live.live_feed(stored))
    assert 0 < files_read(found) < len(stored.inputFiles())


def test_one_user_reaches_the_scan(stored, spark):
    products = spark.range(3000).select(
        F.col("id").alias("product_id"), F.lit("n").alias("name"), F.lit("c").alias("category")
    )
    plan = plan_of(recommend.recommend_user(landing.score_increments(stored), products, 5))
    assert "EqualTo(user_id,5)" in plan
    assert any(c == "user_id:bigint,product_id:bigint,event_type:string" for c in read_columns(plan))


def test_each_users_list_is_cut_before_the_shuffle(stored, spark):
    products = spark.range(3000).select(
        F.col("id").alias("product_id"), F.lit("n").alias("name"), F.lit("c").alias("category")
    )
    plan = plan_of(recommend.recommend_all(landing.score_increments(stored), products))
    exchange = plan.index("Exchange hashpartitioning(user_id")
    assert "Partial" in plan[exchange : exchange + 400]


def test_busy_sessions_are_counted_before_the_join(stored, sessions):
    """Before the join there is one row per session and user, however hot the session."""
    plan = plan_of(daily.device_source(stored, sessions))
    join = plan.index("Join")
    assert "partial_count" in plan[join:]
    hot = daily.on_day(stored).filter("session_id = 0")
    counted = hot.groupBy("session_id", "user_id").count()
    assert counted.count() == 1 < hot.count()


def test_pairs_are_summed_in_one_shuffle(stored, sessions, spark):
    orders = spark.range(100).select(
        F.col("id").alias("order_id"), (F.col("id") % 7).alias("customer_id")
    )
    items = spark.range(300).select(
        (F.col("id") % 100).alias("order_id"), (F.col("id") % 11).alias("product_id")
    )
    plan = plan_of(interactions.interactions(stored, sessions, orders, items))
    assert plan.count("Exchange hashpartitioning(user_id") == 1


def test_views_of_a_busy_session_are_summed_before_the_join(stored, sessions):
    plan = plan_of(interactions.scored_views(stored, sessions))
    join = plan.index("Join")
    assert "partial_sum" in plan[join:] and "partial_sum" not in plan[:join]
    views = interactions.scored_views(stored.filter("session_id = 0"), sessions)
    assert views.count() == 1501


def test_hot_keys_give_the_right_sums(stored, generated, sessions):
    """A third of the rows in one user, session and product changes no result."""
    scores = landing.score_increments(stored)
    hot = generated.filter("user_id = 0")
    expected = hot.groupBy("product_id").agg(
        F.sum(
            F.expr(
                "CASE event_type WHEN 'page_view' THEN 1 WHEN 'add_to_cart' THEN 5"
                " WHEN 'checkout' THEN 7 ELSE 10 END"
            )
        ).alias("points")
    )
    joined = scores.filter("user_id = 0").join(expected, "product_id")
    assert joined.filter("popularity_score <> points").count() == 0
    assert joined.count() == expected.count()
    clicks = cleaning.rejected_events(generated.drop("user_id"), sessions)
    assert clicks.count() == 0


def test_unseen_products_of_a_hot_user(spark, generated):
    pairs = Staging(spark).put(
        interactions.sum_pairs(
            generated.select("user_id", "product_id", F.lit(1).cast("long").alias("interaction_score"))
        ),
        "pairs",
    )
    frame = recommend.recommend_unseen(pairs, Staging(spark), near_rows=300, block=64)
    seen = {r.product_id for r in pairs.filter("user_id = 0").collect()}
    popularity = sorted(
        rows(interactions.product_popularity(pairs)), key=lambda r: (-r[1], r[0])
    )
    for user in (0, 1, 500):
        seen = {r.product_id for r in pairs.filter(F.col("user_id") == user).collect()}
        expected = [p for p, _ in popularity if p not in seen][:5]
        found = frame.filter(F.col("user_id") == user).orderBy("rank")
        assert [r.product_id for r in found.collect()] == expected
