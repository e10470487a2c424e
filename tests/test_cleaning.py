from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clickloom.operators import cleaning
from clickloom.schemas import EVENTS, SCORER_MESSAGE, SESSIONS
from frames import at, click_log, rows, values

NAN = float("nan")


@pytest.fixture
def events(spark):
    frame = spark.createDataFrame(
        [
            (1, 7, " purchase ", at("2024-01-02"), 1.0, NAN, 20.0, NAN),
            (1, 8, None, at("2024-01-01"), NAN, 2.0, NAN, 0.1),
            (1, None, "page_view", at("2024-01-03"), NAN, NAN, NAN, NAN),
            (99, 7, "page_view", at("2024-01-04"), NAN, NAN, NAN, NAN),
            (None, 7, "page_view", at("2024-01-05"), NAN, NAN, NAN, NAN),
            (2, 7, "page_view", at("2024-01-06"), NAN, NAN, NAN, NAN),
        ],
        EVENTS,
    )
    return frame.withColumn("event_id", F.monotonically_increasing_id())


@pytest.fixture
def sessions(spark):
    return spark.createDataFrame(
        [
            (1, 5, at("2024-01-01"), "mobile", None, "DE"),
            (2, None, at("2024-01-01"), "mobile", "paid", "DE"),
        ],
        SESSIONS,
    )


def test_click_events(events, sessions):
    clicks = cleaning.replay_order(cleaning.click_events(events, sessions))
    found = rows(
        clicks, "user_id", "product_id", "event_type", "qty", "cart_size", "amount_usd", "source"
    )
    assert found == [
        (5, 8, "page_view", None, 2.0, None, None),
        (5, 7, "purchase", 1.0, None, 20.0, None),
    ]


def test_rejected_events_are_counted_by_reason(events, sessions):
    found = dict(rows(cleaning.rejected_events(events, sessions)))
    assert found == {"missing_user": 3, "missing_product": 1}


def test_typed_parse(spark):
    texts = values(
        spark,
        "not json",
        '{"user_id": "x", "product_id": 2, "event_type": "purchase"}',
        '{"user_id": 1, "event_type": "page_view", "extra": [1]}',
        '{"user_id": 1, "product_id": 2, "event_type": "page_view", "extra": 1}',
        None,
    )
    assert rows(cleaning.parse_values(texts, SCORER_MESSAGE)) == [
        (None, None, None),
        (None, 2, "purchase"),
        (1, None, "page_view"),
        (1, 2, "page_view"),
        (None, None, None),
    ]
    assert rows(cleaning.scorer_rows(texts)) == [(1, 2, "page_view")]


def test_bytes_parse_like_text(spark):
    texts = values(spark, '{"user_id": 1, "product_id": 2, "event_type": "page_view"}')
    as_bytes = texts.select(F.col("value").cast("binary").alias("value"))
    assert rows(cleaning.scorer_rows(as_bytes)) == [(1, 2, "page_view")]


def test_quarantine_names_the_first_fault(spark):
    texts = {
        '{"user_id": 1, "product_id": 2, "event_type": "purchase", "session_id": 3}': None,
        '{"user_id": 1, "product_id": 2, "event_type": "purchase"}': None,
        '{"user_id": 1, "product_id": 2, "event_type": "purchase", "qty": "many"}': "bad_qty",
        '{"user_id": 1, "product_id": 2, "event_type": "a", "discount_pct": "x"}': "bad_discount_pct",
        '{"user_id": 1, "product_id": 2, "event_type": "a", "timestamp": "garbage"}': "bad_timestamp",
        '{"user_id": 1, "product_id": 2, "event_type": "a", "start_time": "soon"}': "bad_start_time",
        '{"user_id": 1, "product_id": 2.5, "event_type": "a"}': "bad_product_id",
        '{"user_id": 1.0, "product_id": "2.0", "event_type": "a", "qty": "NaN"}': None,
        '{"user_id": 1, "prod': "bad_json",
        "[1, 2": "bad_json",
        '{"product_id": 2, "event_type": "purchase"}': "missing_user_id",
        '{"user_id": "n/a", "product_id": 2, "event_type": "purchase"}': "bad_user_id",
        '{"user_id": 1, "event_type": "purchase"}': "missing_product_id",
        '{"user_id": 1, "product_id": "x", "event_type": "purchase"}': "bad_product_id",
        '{"user_id": 1, "product_id": 2}': "missing_event_type",
        '{"user_id": 1, "product_id": 2, "event_type": "a", "session_id": "x"}': "bad_session_id",
    }
    checked = cleaning.checked_messages(values(spark, *texts, None))
    assert dict(rows(checked, "value", "reason")) == {**texts, None: "bad_json"}
    assert cleaning.accepted(checked).count() == 3
    assert cleaning.quarantined(checked).count() == 14
    counts = dict(rows(cleaning.quarantine_counts(checked)))
    assert counts["bad_json"] == 3


def test_accepted_fills_defaults(spark):
    text = (
        '{"event_id": 4, "user_id": 1, "product_id": 2, "event_type": " purchase ",'
        ' "timestamp": "2024-01-31T23:30:00.5", "amount_usd": 20.5, "qty": "NaN",'
        ' "session_id": 3, "device": "", "start_time": ""}'
    )
    row = cleaning.accepted(cleaning.checked_messages(values(spark, text))).first()
    assert (row.event_type, str(row.amount_usd), row.qty) == ("purchase", "20.50", None)
    assert str(row.event_date) == "2024-01-31"
    assert (row.device, row.source, row.country) == ("", "", "")
    assert row.start_time == row.timestamp == datetime(2024, 1, 31, 23, 30, 0, 500000)


def test_messages_keep_every_field_even_when_absent(spark):
    log = click_log(spark, [(1, 5, 7, "add_to_cart", "2024-01-01 10:00:00", 3, None)])
    clicks = log.withColumns(
        {
            **{c: F.lit(None).cast("string") for c in cleaning.SESSION_FIELDS},
            "start_time": F.lit(None).cast("timestamp"),
        }
    )
    text = cleaning.to_values(cleaning.event_messages(clicks)).first().value
    assert '"score":5' in text and '"device":null' in text
    back = cleaning.accepted(cleaning.checked_messages(values(spark, text)))
    assert rows(cleaning.log_rows(back)) == rows(log)


def test_a_message_is_parsed_once(spark):
    """A condition on parsed fields must not repeat the parse below it."""
    checked = cleaning.checked_messages(values(spark, "{}", "{"))
    plan = cleaning.accepted(checked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
