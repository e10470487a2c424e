from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.operators import daily, live, search
from clickloom.schemas import PRODUCTS, SESSIONS
from frames import at, click_log, rows


@pytest.fixture
def log(spark):
    return click_log(
        spark,
        [
            (1, 1, 7, "purchase", "2024-01-01 23:59:59", 1, 5.0),
            (2, 1, 7, "page_view", "2024-01-02 00:00:00", 1, None),
            (3, 2, 7, "page_view", "2024-01-02 10:00:00", 2, None),
            (4, 2, 8, "purchase", "2024-01-02 10:00:01", 2, 9.0),
            (5, 3, 9, "wishlist", "2024-01-02 10:00:02", None, None),
        ],
    )


@pytest.fixture
def sessions(spark):
    return spark.createDataFrame(
        [
            (1, 1, at("2024-01-01"), "mobile", "paid", "DE"),
            (2, 2, at("2024-01-01"), "mobile", None, "XX"),
        ],
        SESSIONS,
    )


def test_daily_kpis(log):
    assert rows(daily.daily_kpis(log), "total_events", "active_users", "purchases", "avg_score") == [
        (4, 3, 1, 3.25)
    ]


def test_daily_kpis_of_an_empty_log(spark):
    assert rows(daily.daily_kpis(click_log(spark, []))) == [(0, 0, 0, 0.0, None)]


def test_daily_kpis_of_a_given_day(log):
    found = daily.daily_kpis(log, F.lit("2024-01-01").cast("date"))
    assert rows(found, "total_events", "purchases") == [(1, 1)]


def test_traffic(log, sessions):
    by_device_source = daily.device_source(log, sessions)
    assert rows(by_device_source) == [("mobile", None, 1, 2), ("mobile", "paid", 1, 1)]
    totals = rows(daily.traffic_breakdown(by_device_source))
    assert totals == [("device", "mobile", 3), ("source", None, 2), ("source", "paid", 1)]
    assert sum(v for kind, _, v in totals if kind == "source") == 3


def test_countries(spark, log, sessions):
    active = daily.active_countries(log, sessions)
    assert rows(active) == [("DE", 1), ("XX", 1)]
    names = spark.createDataFrame([("DE", "Germany")], "country string, display_name string")
    assert rows(daily.country_intensity(active, names)) == [
        ("DE", "Germany", 1, 1.0),
        ("XX", "XX", 1, 1.0),
    ]
    assert rows(daily.country_intensity(active.limit(0), names)) == []


def test_top_users_break_ties_by_id(spark, log):
    people = spark.createDataFrame(
        [(1, "a", "DE"), (2, "b", "XX")], "customer_id long, name string, country string"
    )
    assert rows(daily.top_users(log, people), "user_id", "total_score") == [(1, 11), (2, 11)]
    assert rows(daily.top_users(log, people, 1), "user_id") == [(1,)]


def test_recent_events_and_nulls_last(spark, log):
    untimed = click_log(spark, [(9, 9, 9, "page_view", None, None, None)])
    found = live.recent_events(log.unionByName(untimed), 2)
    assert rows(found) == [
        (3, 9, "wishlist", "2024-01-02T10:00:02.000000"),
        (2, 8, "purchase", "2024-01-02T10:00:01.000000"),
    ]


@pytest.mark.parametrize("limit", [1, 4, 5, 9])
def test_recent_days_change_nothing(spark, log, limit):
    untimed = click_log(spark, [(9, 9, 9, "page_view", None, None, None)])
    whole = log.unionByName(untimed)
    pruned = live.recent_days(whole, limit)
    expected = rows(live.recent_events(whole, limit))
    assert len(expected) == min(limit, 6)
    assert rows(live.recent_events(pruned, limit)) == expected
    assert rows(live.live_feed(live.recent_distinct(whole, limit), limit)) == rows(live.live_feed(whole, limit))
    copies = log.unionByName(log)
    distinct = live.recent_distinct(copies, limit)
    assert rows(live.live_feed(distinct, limit)) == rows(live.live_feed(log, limit))


def test_recent_days_leave_out_older_ones(log):
    assert live.recent_days(log, 4).count() == 4
    assert live.recent_days(log, 5).count() == 5
    copies = log.unionByName(log)
    assert live.recent_distinct(copies, 2).count() == 4
    assert live.recent_distinct(copies, 4).count() == 8
    assert live.recent_distinct(copies, 5).count() == 10
    assert live.recent_distinct(copies, 2, ["user_id"]).count() == 10


def test_a_short_newest_day_leaves_old_days_unread(spark):
    days = [(i, i, 1, "page_view", f"2024-01-{1 + i // 10:02d} 10:00:{i % 10:02d}", 3, None) for i in range(90)]
    log = click_log(spark, [*days, (90, 1, 1, "page_view", "2024-01-10 09:00", 3, None)])
    kept = live.recent_distinct(log.unionByName(log), 15)
    assert kept.agg(F.min("event_date")).first()[0].day == 8
    assert rows(live.live_feed(kept, 15)) == rows(live.live_feed(log, 15))


def test_the_feed_keeps_events_without_ids_and_top_products_count_copies_once(spark):
    bare = click_log(spark, [(None, 1, 7, "purchase", "2024-01-02 10:00:00", None, 20.0)])
    copies = bare.unionByName(bare).unionByName(bare)
    assert rows(live.live_feed(copies), "event_id", "event_type", "score_label") == [(None, "purchase", "+10")]
    names = spark.createDataFrame([(7, "lamp")], "product_id long, name string")
    assert rows(live.live_top_products(copies, names)) == [(7, "lamp", 10)]


def test_live_feed_labels(log):
    assert rows(
        live.live_feed(log, 2), "time_label", "date_label", "event_label", "score_label"
    ) == [
        ("10:00:02", "02 Jan 2024", "user_3 → product_9", "+1"),
        ("10:00:01", "02 Jan 2024", "user_2 → product_8", "+10"),
    ]


def test_live_top_products(spark, log):
    names = spark.createDataFrame([(7, "lamp")], "product_id long, name string")
    assert rows(live.live_top_products(log, names)) == [
        (7, "lamp", 12),
        (8, "product_8", 10),
        (9, "product_9", 1),
    ]
    assert rows(live.live_top_products(log, names, buffer=1)) == [(9, "product_9", 1)]
    assert rows(live.live_top_products(log, names, limit=1)) == [(7, "lamp", 12)]


@pytest.fixture
def products(spark):
    listed = [
        (1, "Tools", "red RING", 9.5),
        (2, "Rings", "bolt", 1.0),
        (3, "Rings", "ring", 10.0),
        (4, "Tools", "50% off", 5.0),
        (5, "Tools", "nut", 5.0),
    ]
    frame = spark.createDataFrame(listed, "product_id long, category string, name string, p double")
    return frame.select(
        "product_id", "category", "name", F.col("p").cast(PRODUCTS["price_usd"].dataType).alias("price_usd")
    )


def test_search_ranks_name_before_category(products):
    assert rows(search.product_search(products, "ring"), "product_id", "score") == [
        (1, 3.0),
        (3, 3.0),
        (2, 2.0),
    ]


def test_search_prices_include_both_ends(products):
    assert rows(search.product_search(products, "ring", 1.0, 9.5), "product_id") == [(1,), (2,)]
    assert rows(search.product_search(products, "ring", 1.005, 9.495), "product_id") == []


def test_search_wildcards(products):
    assert search.product_search(products, "%").count() == 5
    assert rows(search.product_search(products, "b_lt"), "product_id") == [(2,)]
    assert rows(search.product_search(products, "t", limit=1), "product_id") == [(2,)]
