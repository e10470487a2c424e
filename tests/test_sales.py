from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import sales
from frames import at, click_log, rows


def sale(event_id, session, time, amount, kind="purchase", product=2):
    return (event_id, 1, product, kind, time, session, amount)


def test_a_session_counts_once_at_its_last_purchase(spark):
    log = click_log(
        spark, [sale(1, 3, "2024-01-01 10:20", 35.0), sale(2, 3, "2024-01-01 11:20", 20.0)]
    )
    assert rows(sales.sales_trend(log, "hour")) == [(at("2024-01-01 11:00"), 1, 35.0)]


def test_scope_edge(spark):
    log = click_log(
        spark, [sale(1, 3, "2024-01-31 23:00", 10.0), sale(2, 3, "2024-02-01 01:00", 5.0)]
    )
    assert rows(sales.sales_trend(log, "day", 2024, 1)) == [(at("2024-01-31"), 1, 10.0)]
    assert rows(sales.sales_trend(log, "year")) == [(at("2024-01-01"), 1, 10.0)]
    assert rows(sales.sales_trend(log, "month")) == [(at("2024-02-01"), 1, 10.0)]
    assert rows(sales.sales_trend(log, "unknown")) == [(at("2024-02-01"), 1, 10.0)]


def test_only_priced_purchases_are_sales(spark):
    log = click_log(
        spark,
        [
            sale(1, 3, "2024-01-01", 10.0, "checkout"),
            sale(2, None, "2024-01-01", None),
            sale(3, 4, "2024-01-02", 7.0),
        ],
    )
    assert rows(sales.sales_trend(log, "day")) == [(at("2024-01-02"), 1, 7.0)]
    assert rows(sales.sales_filters(log)) == [(2024, 1, 2)]
    assert rows(sales.sales_filter_values(sales.sales_filters(log))) == [
        ("day", 2),
        ("month", 1),
        ("year", 2024),
    ]


def test_category_sales(spark):
    log = click_log(
        spark,
        [
            sale(1, 3, "2024-01-01", 10.0),
            sale(2, 3, "2024-01-01", 5.0),
            sale(3, 4, "2024-01-01", 99.0, "checkout"),
            sale(4, 5, "2024-01-01", 1.0, product=8),
            sale(5, 5, "2024-01-01", 1.0, product=404),
            sale(6, 6, "2024-01-01", None, "page_view", product=9),
        ],
    )
    products = spark.createDataFrame(
        [(2, "a"), (8, "b"), (9, "c")], "product_id long, category string"
    )
    found = sales.category_labels(sales.category_sales(log, products))
    assert rows(found) == [
        ("a", 2, 3, 15.0, "$15", "$15"),
        ("b", 1, 1, 1.0, "$1", "$1"),
        ("c", 1, 1, 0.0, "$0", "$0"),
    ]


def test_labels(spark):
    log = click_log(spark, [sale(1, 3, "2024-01-05 10:20", 1234.5)])
    for granularity, label in {"hour": "10:00", "day": "5 Jan", "month": "Jan 2024"}.items():
        found = sales.sales_labels(sales.sales_trend(log, granularity), granularity)
        assert rows(found, "period_label", "revenue_tick", "revenue_label") == [
            (label, "$1k", "$1,234.5")
        ]


def test_empty_log(spark):
    log = click_log(spark, [])
    assert rows(sales.sales_trend(log)) == []
    assert rows(sales.sales_filters(log)) == []


def test_money_adds_up_exactly(spark):
    log = click_log(spark, [sale(i, i, "2024-01-01", 0.1) for i in range(10)])
    assert rows(sales.sales_trend(log, "year"), "revenue") == [(1.0,)]
    assert log.agg(F.sum("amount_usd")).first()[0].as_tuple().exponent == -2
