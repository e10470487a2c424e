from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import landing, quality
from clickloom.schemas import CLICK_LOG
from frames import at, click_log, rows


def test_score_example(spark):
    seen = [(i, 1, 2, "page_view", "2024-01-01", 3, None) for i in range(3)]
    seen.append((4, 1, 2, "add_to_cart", "2024-01-01", 3, None))
    stored = landing.score_increments(click_log(spark, seen))
    assert rows(stored) == [(1, 2, 8)]
    later = click_log(spark, [(5, 1, 2, "purchase", "2024-01-02", 3, 9.0)])
    assert rows(landing.merge_scores(stored, landing.score_increments(later))) == [(1, 2, 18)]


def test_unscored_without_user_or_product(spark):
    log = click_log(
        spark,
        [
            (1, None, 2, "page_view", "2024-01-01", 3, None),
            (2, 1, None, "page_view", "2024-01-01", 3, None),
            (3, 1, 2, "wishlist", "2024-01-01", 3, None),
        ],
    )
    assert rows(landing.score_increments(log)) == [(1, 2, 1)]


def test_first_session_row_wins(spark):
    clicks = click_log(
        spark,
        [
            (2, 1, 2, "page_view", "2024-01-01 10:00", 3, None),
            (1, 1, 2, "page_view", "2024-01-01 10:00", 3, None),
            (0, 1, 2, "page_view", "2024-01-01 11:00", 3, None),
            (3, 1, 2, "page_view", "2024-01-01 09:00", None, None),
        ],
    ).withColumns(
        {
            "device": F.concat(F.lit("device "), F.col("event_id").cast("string")),
            "source": F.lit(""),
            "country": F.lit(""),
            "start_time": F.col("timestamp"),
        }
    )
    assert rows(landing.sessions_first(clicks), "session_id", "device") == [(3, "device 1")]


def test_duplicate_delivery(spark):
    log = click_log(
        spark,
        [
            (5, 1, 2, "page_view", "2024-01-01 10:00", 3, None),
            (4, 1, 2, "add_to_cart", "2024-01-01 10:00", 3, None),
            (6, 1, 2, "page_view", "2024-01-01 10:01", 3, None),
        ],
    )
    twice = log.unionByName(log)
    assert sorted(rows(landing.dedup_events(twice), "event_id")) == [(4,), (6,)]
    by_type = landing.dedup_events(twice, ["user_id", "product_id", "timestamp", "event_type"])
    assert sorted(rows(by_type, "event_id")) == [(4,), (5,), (6,)]
    assert twice.count() == 6


def test_manual_events(spark):
    entries = spark.createDataFrame([(1, 2, None), (1, 2, "purchase")], "user_id long, product_id long, event_type string")
    log = landing.manual_events(entries)
    assert log.columns == CLICK_LOG.names
    assert rows(log, "event_type", "session_id", "amount_usd") == [
        ("page_view", None, None),
        ("purchase", None, None),
    ]
    assert log.filter(F.col("timestamp").isNull() | F.col("event_date").isNull()).count() == 0
    timed = entries.withColumn("timestamp", F.lit(at("2024-01-01")))
    assert rows(landing.manual_events(timed).select("timestamp").distinct()) == [(at("2024-01-01"),)]


def test_key_check_and_audit(spark):
    frame = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 2), (None, 2), (None, 2)], "user_id long, product_id long"
    )
    found = quality.key_check(frame, "t", ["user_id", "product_id"])
    assert rows(found) == [("t", "user_id,product_id", 5, 2, 1)]
    empty = frame.limit(0)
    assert rows(quality.key_check(empty, "t", ["user_id"])) == [("t", "user_id", 0, 0, 0)]
    assert dict(rows(quality.load_audit({"a": frame, "b": empty}))) == {"a": 5, "b": 0}
