from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import types as T

from clickloom.plans.dashboard import Dashboard
from clickloom.session import streaming_session
from clickloom.sources.kafka import read_files
from clickloom.streaming import jobs
from clickloom.streaming.batch_table import BatchTable, newest, summed
from clickloom.streaming.lifecycle import drain, start, stop
from frames import rows

MODES = {
    "running": (jobs.running_scores_table, jobs.running_scores),
    "incremental": (jobs.score_increments_table, jobs.incremental_scores),
}


class Feed:
    """A folder of message files, one micro-batch per file."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.folder = str(folder)
        folder.mkdir()
        self.files = 0

    def send(self, *messages) -> None:
        texts = [m if isinstance(m, str) else json.dumps(m) for m in messages]
        path = f"{self.folder}/{self.files:04d}.json"
        with open(path, "w") as file:
            file.write("\n".join(texts) + "\n")
        # Files are streamed in order of their modification times.
        os.utime(path, (1_700_000_000 + self.files,) * 2)
        self.files += 1

    def stream(self):
        sibling = streaming_session(self.spark)
        sibling.conf.set("spark.sql.shuffle.partitions", "2")
        return read_files(sibling, self.folder, files_per_trigger=1)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "feed")


def event(kind="page_view", user=1, product=2, **more):
    return {"user_id": user, "product_id": product, "event_type": kind, **more}


def landed(number, time, user=1, product=2, kind="page_view", **more):
    return event(kind, user, product, event_id=number, timestamp=time, **more)


@pytest.mark.parametrize("mode", MODES)
def test_score_example_over_batches_and_a_restart(spark, feed, tmp_path, mode):
    make_table, job = MODES[mode]
    table = make_table(str(tmp_path / "job")).create(spark)
    assert rows(table.read(spark)) == []
    feed.send(event(), event(), event())
    feed.send(event("add_to_cart"), "broken {", {"user_id": 1})
    drain(job(feed.stream(), table))
    assert rows(table.read(spark)) == [(1, 2, 8)]
    feed.send(event("purchase"), event(user=3))
    drain(job(feed.stream(), table))
    assert sorted(rows(table.read(spark))) == [(1, 2, 18), (3, 2, 1)]
    table.create(spark)
    drain(job(feed.stream(), table))
    assert sorted(rows(table.read(spark))) == [(1, 2, 18), (3, 2, 1)]


@pytest.mark.parametrize("mode", MODES)
def test_compaction_keeps_the_result(spark, feed, tmp_path, mode):
    make_table, job = MODES[mode]
    table = make_table(str(tmp_path / "job")).create(spark)
    for _ in range(3):
        feed.send(event(), event(user=5))
    drain(job(feed.stream(), table))
    before = sorted(rows(table.read(spark)))
    table.compact(spark, upto=1)
    assert sorted(rows(table.read(spark))) == before == [(1, 2, 3), (5, 2, 3)]
    feed.send(event("purchase"))
    drain(job(feed.stream(), table))
    table.compact(spark, upto=0)
    assert sorted(rows(table.read(spark))) == [(1, 2, 13), (5, 2, 3)]
    table.compact(spark, upto=3)
    assert sorted(rows(table.read(spark))) == [(1, 2, 13), (5, 2, 3)]


def score_rows(spark, points):
    return spark.createDataFrame([(1, 2, points)], jobs.USER_SCORES)


@pytest.mark.parametrize(("fold", "expected"), [(newest, 18), (summed, 26)])
def test_a_batch_written_twice_counts_once(spark, tmp_path, fold, expected):
    table = BatchTable(
        str(tmp_path), "t", jobs.USER_SCORES, fold(jobs.SCORE_KEY, "popularity_score")
    ).create(spark)
    for batch_id, points in [(0, 8), (1, 18), (1, 18), (0, 8)]:
        table.write(score_rows(spark, points), batch_id)
    assert rows(table.read(spark)) == [(1, 2, expected)]


def test_empty_snapshot_still_covers_its_batches(spark, tmp_path):
    table = jobs.running_scores_table(str(tmp_path)).create(spark)
    table.write(score_rows(spark, 8).limit(0), 0)
    table.compact(spark, upto=0)
    table.write(score_rows(spark, 9), 1)
    assert rows(table.read(spark)) == [(1, 2, 9)]


MESSAGES = [
    landed(3, "2024-01-02T00:10:00", session_id=7, device="mobile"),
    landed(1, "2024-01-01T23:50:00", session_id=7, device="tablet", start_time="2024-01-01T23:00"),
    landed(2, "2024-01-01T10:00:00", kind="purchase", session_id=8, amount_usd=9.5),
    landed(4, "2024-01-02T10:00:00"),
]


def test_landing(spark, feed, tmp_path):
    """Log, sessions and rejects from one query; the session that started first wins although
    it arrives later, and an event eleven hours late is kept."""
    root = str(tmp_path / "job")
    jobs.sessions_table(root).create(spark)
    feed.send(MESSAGES[0], MESSAGES[3], "broken {")
    feed.send(*MESSAGES[1:3], landed(5, "2024-01-02T10:00:00", user="x"))
    drain(jobs.land(feed.stream(), root))

    log = jobs.landed_log(spark, root)
    assert sorted(rows(log, "event_id", "session_id")) == [(1, 7), (2, 8), (3, 7), (4, None)]
    assert str(log.filter("event_id = 2").first().amount_usd) == "9.50"
    days = sorted(p.name for p in (tmp_path / "job" / "click_log" / "rows").glob("event_date=2*"))
    assert days == ["event_date=2024-01-01", "event_date=2024-01-02"]

    found = jobs.landed_sessions(spark, root).orderBy("session_id")
    assert rows(found, "session_id", "device", "country") == [(7, "tablet", ""), (8, "", "")]
    assert [str(r.start_time) for r in found.collect()] == [
        "2024-01-01 23:00:00",
        "2024-01-01 10:00:00",
    ]
    rejects = sorted(rows(jobs.quarantine_log(spark, root), "reason"))
    assert rejects == [("bad_json",), ("bad_user_id",)]


def test_landing_a_batch_again_changes_nothing(spark, feed, tmp_path):
    """The same batch after a crash before its commit: remove the commit, run again."""
    root = str(tmp_path / "job")
    jobs.sessions_table(root).create(spark)
    feed.send(*MESSAGES[:2])
    feed.send(*MESSAGES[2:], "broken {", '{"user_id": 8, "product_id": 9, "event_type": "untimed"}')
    drain(jobs.land(feed.stream(), root))
    before = sorted(map(str, rows(jobs.landed_log(spark, root))))
    for commit in (tmp_path / "job" / "checkpoint" / "commits").glob("*1*"):
        commit.unlink()
    spark.catalog.clearCache()
    drain(jobs.land(feed.stream(), root))
    assert sorted(map(str, rows(jobs.landed_log(spark, root)))) == before
    assert jobs.quarantine_log(spark, root).count() == 1
    assert jobs.landed_sessions(spark, root).count() == 2


def test_session_order_does_not_depend_on_batches(spark, feed, tmp_path):
    feed.send(*MESSAGES)
    one, several = str(tmp_path / "one"), str(tmp_path / "several")
    jobs.sessions_table(one).create(spark)
    drain(jobs.land(feed.stream(), one))
    apart = Feed(spark, tmp_path / "apart")
    for message in MESSAGES:
        apart.send(message)
    table = jobs.sessions_table(several).create(spark)
    drain(jobs.land(apart.stream(), several))
    table.compact(spark, upto=1)
    assert sorted(rows(jobs.landed_sessions(spark, several))) == sorted(
        rows(jobs.landed_sessions(spark, one))
    )


def test_dedup_with_and_without_a_watermark(spark, feed, tmp_path):
    """A late first-time event is kept without a delay and dropped behind the watermark."""
    newest_event = landed(1, "2024-01-02T12:00:00")
    feed.send(newest_event, newest_event)
    feed.send(newest_event, landed(2, "2024-01-02T12:30:00"))
    feed.send(landed(3, "2024-01-02T01:00:00"), landed(4, "2024-01-02T12:20:00"))
    found = {}
    for name, delay in {"exact": None, "bounded": "1 hour"}.items():
        root = str(tmp_path / name)
        drain(jobs.append_files(jobs.distinct_events(feed.stream(), delay=delay), root))
        kept = spark.read.schema("event_id long").parquet(f"{root}/rows")
        found[name] = sorted(r.event_id for r in kept.collect())
    assert found == {"exact": [1, 2, 3, 4], "bounded": [1, 2, 4]}


def test_distinct_log_loses_nothing_and_forgets(spark, feed, tmp_path):
    """Events come once, late ones included, whether their copy is remembered or looked up in the
    log; keys leave the state, and a batch that is run again does not take itself for a copy."""
    root = str(tmp_path / "job")
    states = []

    def land():
        query = drain(jobs.land_distinct(feed.stream(), root, remember="1 second", ahead="0 seconds", close_every=4))
        states.append(sum(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]))

    feed.send(landed(1, "2024-01-02T12:00:00"), landed(1, "2024-01-02T12:00:00"), *[landed(100 + i, "2024-01-03T00:00:00", user=i) for i in range(50)])
    land()
    for number, day in ((2, "2024-01-09"), (3, "2024-01-01"), (4, "2024-01-09"), (5, "2024-01-02")):
        time.sleep(2.5)
        feed.send(landed(number, f"{day}T0{number}:00:00"), landed(1, "2024-01-02T12:00:00"), landed(100, "2024-01-03T00:00:00", user=0))
        land()
    expected = sorted([1, 2, 3, 4, 5, *range(100, 150)])
    found = jobs.distinct_log(root).read(spark)
    assert sorted(r.event_id for r in found.collect()) == expected
    assert states[0] >= 51 and states[-1] < 20
    newest = max((tmp_path / "job" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    newest.with_name(f".{newest.name}.crc").unlink()
    land()
    assert sorted(r.event_id for r in jobs.distinct_log(root).read(spark).collect()) == expected


def test_start_and_stop(spark, feed, tmp_path):
    table = jobs.score_increments_table(str(tmp_path / "job")).create(spark)
    feed.send(event())
    query = start(jobs.incremental_scores(feed.stream(), table), "200 milliseconds")
    query.processAllAvailable()
    stop(query)
    assert not query.isActive
    assert rows(table.read(spark)) == [(1, 2, 1)]


def test_dashboard_over_landed_tables(spark, feed, tmp_path):
    root = str(tmp_path / "job")
    jobs.sessions_table(root).create(spark)
    table = jobs.running_scores_table(root).create(spark)
    feed.send(*MESSAGES)
    drain(jobs.land(feed.stream(), root))
    drain(jobs.running_scores(feed.stream(), table))
    products = spark.createDataFrame(
        [(2, "lamp", "home", 5.0)], "product_id long, name string, category string, price_usd double"
    )
    customers = spark.createDataFrame(
        [(1, "Ann", "DE")], "customer_id long, name string, country string"
    )
    board = Dashboard.from_landing(spark, root, products, customers)
    assert rows(board.daily_stats(), "total_events", "active_users") == [(2, 1)]
    assert rows(board.recommend(1), "name", "score") == [("lamp", 13)]
    assert rows(board.recommend_top(), "name", "rank") == [("lamp", 1)]
    assert rows(board.recommendation_bars(), "percent_of_best") == [(100,)]
    assert rows(board.top_users(), "name", "total_score") == [("Ann", 13)]
    assert rows(board.sales_trend("day"), "period_label", "revenue_label") == [("1 Jan", "$9.5")]
    assert len(rows(board.sales_trend_filters())) == 3
    assert rows(board.top_categories(), "category", "total_revenue") == [("home", 9.5)]
    assert rows(board.device_stats(), "kind", "name", "value") == [
        ("device", "tablet", 1),
        ("source", "", 1),
    ]
    assert rows(board.country_map(), "country", "intensity") == [("", 1.0)]
    assert len(rows(board.live_feed())) == len(rows(board.recent_events())) == 4
    assert rows(board.top_products(), "name", "score") == [("lamp", 13)]
    assert rows(board.search("LAMP"), "product_id") == [(2,)]


def test_folders_stay_few_over_many_batches(spark, tmp_path):
    fold = summed(["user_id"], "score")
    table = BatchTable(str(tmp_path), "t", T.StructType([T.StructField("user_id", T.LongType()), T.StructField("score", T.LongType())]), fold, fold_every=5)
    table.create(spark)
    for batch_id in range(50):
        rows_of_batch = spark.range(1).selectExpr("id AS user_id", f"CAST({batch_id} AS BIGINT) AS score")
        table.write(rows_of_batch, batch_id)
        if batch_id == 25:
            # The batch that folds is run again.
            table.write(rows_of_batch, batch_id)
    assert rows(table.read(spark)) == [(0, sum(range(50)))]
    assert len(list((tmp_path / "t" / "batches").glob("batch_id=*"))) <= 12
    assert len(list((tmp_path / "t" / "snapshots").glob("upto=*"))) <= 4
