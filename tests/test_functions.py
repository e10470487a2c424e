from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clickloom.functions import labels, periods, values
from clickloom.functions.scoring import BATCH, LIVE, score

TYPES = ["page_view", "add_to_cart", "checkout", "purchase", "wishlist", None]


@pytest.mark.parametrize(
    ("weights", "expected"), [(LIVE, [1, 5, 7, 10, 1, 1]), (BATCH, [1, 3, 7, 0, 0, 0])]
)
def test_weights_with_unknown_and_null_types(spark, weights, expected):
    frame = spark.createDataFrame(list(enumerate(TYPES)), "i int, event_type string")
    found = frame.select("i", score(weights).alias("s")).orderBy("i").collect()
    assert [r.s for r in found] == expected


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("total", "count", "mean"), [(467, 100, 4.67), (1, 8, 0.13), (5, 1000, 0.01), (0, 3, 0.0)]
)
def test_rounded_mean_is_half_up(spark, total, count, mean):
    assert one(spark, values.rounded_mean(F.lit(total), F.lit(count))) == mean


def test_money_rounds_the_decimal_half_away_from_zero(spark):
    assert one(spark, values.money_out(F.lit(Decimal("1.005")))) == 1.01
    assert one(spark, values.money_out(F.lit(Decimal("-1.005")))) == -1.01


def test_percent(spark):
    assert one(spark, values.rounded_percent(F.lit(1), F.lit(8))) == 13
    assert one(spark, values.rounded_percent(F.lit(7), F.lit(7))) == 100


def test_untrusted_values(spark):
    assert one(spark, values.id_or_null(F.lit("12"))) == 12
    assert one(spark, values.id_or_null(F.lit("n/a"))) is None
    assert one(spark, values.number_or_null(F.lit(float("nan")))) is None
    assert one(spark, values.text_or(F.lit(""), F.lit("x"))) == "x"
    assert one(spark, values.text_or(F.lit(None).cast("string"), F.lit("x"))) == "x"


@pytest.mark.parametrize(
    ("amount", "tick", "category_tick", "label"),
    [
        ("35.00", "$35", "$35", "$35"),
        ("35.50", "$35.5", "$35.5", "$35.5"),
        ("100.00", "$100", "$100", "$100"),
        ("1000.00", "$1k", "$1000", "$1,000"),
        ("1500.00", "$2k", "$2k", "$1,500"),
        ("12345678.05", "$12346k", "$12346k", "$12,345,678.05"),
    ],
)
def test_money_labels(spark, amount, tick, category_tick, label):
    cents = F.lit(Decimal(amount))
    assert one(spark, labels.money_tick(cents, from_exactly_1000=True)) == tick
    assert one(spark, labels.money_tick(cents, from_exactly_1000=False)) == category_tick
    assert one(spark, labels.money_label(cents)) == label


@pytest.mark.parametrize(
    ("granularity", "label", "start"),
    [
        ("hour", "7:00", datetime(2024, 1, 5, 7)),
        ("day", "5 Jan", datetime(2024, 1, 5)),
        ("month", "Jan 2024", datetime(2024, 1, 1)),
        ("year", "2024", datetime(2024, 1, 1)),
        ("week", "2024-01-01T00:00:00", datetime(2024, 1, 1)),
    ],
)
def test_periods(spark, granularity, label, start):
    time = F.lit(datetime(2024, 1, 5, 7, 8, 9))
    period = periods.period_start(time, granularity)
    assert one(spark, period.cast("string")) == str(start)
    assert one(spark, periods.period_label(period, granularity)) == label


@pytest.mark.parametrize(
    ("granularity", "year", "month", "day", "kept"),
    [
        ("hour", 2024, 1, 30, 1),
        ("day", 2024, 1, 30, 2),
        ("month", 2024, 1, 30, 3),
        ("year", 2024, 1, 30, 4),
        ("day", None, 1, None, 3),
        ("day", 0, 1, None, 3),
        ("decade", 2024, 1, 30, 4),
    ],
)
def test_scope_uses_only_the_parts_of_its_granularity(spark, granularity, year, month, day, kept):
    days = [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), date(2023, 1, 30)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    for condition in periods.scope_filters(F.col("d"), granularity, year, month, day):
        frame = frame.filter(condition)
    assert frame.count() == kept


def test_feed_labels(spark):
    time = F.lit("2024-01-05 07:08:09.012345").cast("timestamp")
    assert one(spark, labels.clock(time)) == "07:08:09"
    assert one(spark, labels.day_label(time)) == "05 Jan 2024"
    assert one(spark, labels.iso(time)) == "2024-01-05T07:08:09.012345"
    assert one(spark, labels.event_label(F.lit(3), F.lit(9))) == "user_3 → product_9"
    assert one(spark, labels.score_label(F.lit(5))) == "+5"
