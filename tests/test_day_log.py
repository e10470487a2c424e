"""The landed log: closing days, late and repeated batches, day counts."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.operators import live
from clickloom.plans.dashboard import Dashboard
from clickloom.schemas import CLICK_LOG, USER_SCORES
from clickloom.streaming import jobs
from clickloom.streaming.day_log import DayLog
from frames import click_log, rows
from plan_text import plan_of

FIRST = datetime(2024, 1, 1)


@pytest.fixture
def log(spark, tmp_path):
    return DayLog(str(tmp_path), "log", CLICK_LOG).create(spark)


def batch(spark, number, day, n=2):
    """Events of a batch: ids from its number, all on one day."""
    time = str(FIRST + timedelta(days=day, minutes=number))
    return click_log(spark, [(100 * number + i, i, i, "page_view", time, 1, None) for i in range(n)])


def ids(frame):
    return sorted(r.event_id for r in frame.select("event_id").collect())


def folders(tmp_path, kind):
    return sorted(str(p.relative_to(tmp_path / "log")) for p in (tmp_path / "log" / kind).glob("event_date=2*/*"))


def expected(*numbers, n=2):
    return sorted(100 * b + i for b in numbers for i in range(n))


def test_reads_list_days_after_many_batches(spark, log, tmp_path):
    for number in range(50):
        log.write(batch(spark, number, number // 10), number)
    before = ids(log.read(spark))
    assert log.close(spark, 49) == [date(2024, 1, d) for d in (1, 2, 3, 4)]
    assert ids(log.read(spark)) == before == expected(*range(50))
    # The batches stay for readers that have listed them, and go with the next call.
    assert len(folders(tmp_path, "rows")) == 50
    assert log.close(spark, 49) == []
    assert len(folders(tmp_path, "rows")) == 10
    assert folders(tmp_path, "days") == [f"days/event_date=2024-01-0{d}/upto=49" for d in (1, 2, 3, 4)]
    assert ids(log.read(spark)) == before
    assert len(log.read(spark).filter("event_date <= DATE'2024-01-04'").inputFiles()) < 50 + 10


def test_late_and_repeated_batches(spark, log, tmp_path):
    for number in range(4):
        log.write(batch(spark, number, number // 2), number)
    log.close(spark, 3)
    late = batch(spark, 4, 0)
    log.write(late, 4)
    assert ids(log.read(spark)) == expected(0, 1, 2, 3, 4)
    # The same batch again, before and after its day is closed anew.
    log.write(late, 4)
    assert ids(log.read(spark)) == expected(0, 1, 2, 3, 4)
    assert log.close(spark, 4) == []
    assert log.close(spark, 4, late_batches=1) == [date(2024, 1, 1)]
    assert ids(log.read(spark)) == expected(0, 1, 2, 3, 4)
    log.close(spark, 4)
    assert folders(tmp_path, "days") == ["days/event_date=2024-01-01/upto=4"]
    log.write(batch(spark, 5, 2), 5)
    assert ids(log.read(spark)) == expected(0, 1, 2, 3, 4, 5)
    assert rows(log.day_counts(spark).orderBy("event_date"), "n") == [(6,), (4,), (2,)]


def test_an_interrupted_close_changes_nothing(spark, log, monkeypatch):
    for number in range(3):
        log.write(batch(spark, number, number), number)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr("clickloom.streaming.day_log.DayLog.closed", property(lambda self: type("T", (), {"read": lambda s, spark: spark.createDataFrame([], "event_date date, last_batch long"), "schema": "event_date date, last_batch long", "write": fails})()))
        with pytest.raises(RuntimeError):
            log.close(spark, 2)
    assert ids(log.read(spark)) == expected(0, 1, 2)
    assert log.close(spark, 2) == [date(2024, 1, 1), date(2024, 1, 2)]
    assert ids(log.read(spark)) == expected(0, 1, 2)


def test_two_closings_up_to_one_batch_keep_both_notes(spark, log):
    for number in range(4):
        log.write(batch(spark, number, number), number)
    assert log.close(spark, 3, before=date(2024, 1, 2)) == [date(2024, 1, 1)]
    assert log.close(spark, 3) == [date(2024, 1, 2), date(2024, 1, 3)]
    log.close(spark, 3)
    assert ids(log.read(spark)) == expected(0, 1, 2, 3)


def test_rows_before_a_batch(spark, log):
    for number in range(4):
        log.write(batch(spark, number, number % 2), number)
    first = [date(2024, 1, 1)]
    assert ids(log.before_batch(spark, 2, first)) == expected(0)
    log.close(spark, 1)
    assert ids(log.before_batch(spark, 3, first)) == expected(0, 2)
    assert ids(log.before_batch(spark, 3, [date(2030, 1, 1)])) == []


def test_an_empty_log(spark, log):
    assert log.close(spark, 5) == [] and ids(log.read(spark)) == []
    assert spark.range(1).select(log.newest_day(spark).alias("d")).first().d is None
    assert live.recent_distinct(log.read(spark), 5, days=log.day_counts(spark)).count() == 0


def test_day_counts_open_no_file_of_the_log(spark, tmp_path):
    """Counts and the newest day come from the counts table; panels read the newest day alone."""
    root = str(tmp_path)
    jobs.landing_tables(spark, root)
    scores = jobs.running_scores_table(root).create(spark)
    log = jobs.click_log(root)
    for number in range(6):
        log.write(batch(spark, number, number, n=40), number)
    log.close(spark, 5)
    products = spark.createDataFrame([], "product_id long, name string, category string, price_usd double")
    customers = spark.createDataFrame([], "customer_id long, name string, country string")
    board = Dashboard.from_landing(spark, root, products, customers)
    assert scores.schema == USER_SCORES
    for frame in (board.days, spark.range(1).select(board.today.alias("day"))):
        plan = plan_of(frame)
        assert "click_log/counts" in plan and "click_log/rows" not in plan and "click_log/days" not in plan
    kpis = board.daily_stats()
    assert rows(kpis, "total_events", "data_date") == [(40, date(2024, 1, 6))]
    assert rows(board.recent_events(30)) == rows(live.recent_events(log.read(spark), 30))
    assert rows(board.live_feed(70)) == rows(live.live_feed(log.read(spark), 70))
    # The day filter reaches the files of both sides of the log.
    plan = plan_of(board.recent_events(30))
    assert plan.count("PartitionFilters: [") >= 2 and "event_date#" in plan


def test_landing_closes_days_that_are_over(spark, tmp_path):
    from test_streaming import Feed, landed

    feed = Feed(spark, tmp_path / "feed")
    for number in range(8):
        feed.send(landed(number, f"2024-01-0{1 + number // 2}T10:00:00"))
    feed.send(landed(8, "2024-01-01T11:00:00"))
    root = str(tmp_path / "job")
    from clickloom.streaming.lifecycle import drain

    drain(jobs.land(feed.stream(), root, close_every=3))
    found = jobs.landed_log(spark, root)
    assert ids(found) == list(range(9))
    assert sorted(jobs.click_log(root).marks(spark)) == [date(2024, 1, d) for d in (1, 2)]
    assert found.filter(F.col("event_date") == "2024-01-01").count() == 3
