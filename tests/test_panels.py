"""Panels kept up to date by batches equal the panels of the whole log; search by index."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import daily, live, sales, search
from clickloom.streaming.lifecycle import drain
from clickloom.streaming.panels import Panels
from frames import click_log, rows
from plan_text import plan_of
from test_streaming import Feed, landed

KINDS = ["page_view", "add_to_cart", "checkout", "purchase"]


def events(seed, n=90):
    """Events over four days, some across midnight, some untimed, some without an id, some twice."""
    random.seed(seed)
    found = []
    for i in range(n):
        time = f"2024-01-0{random.randint(1, 4)} {random.choice(['00:00:00', '23:59:59', '12:30:00'])}"
        kind = random.choice(KINDS)
        row = (
            None if i % 9 == 4 else i, random.randint(1, 5), random.randint(1, 6), kind,
            None if i % 11 == 3 else time, random.choice([None, 1, 2, 3, 4]), 5.0 + i if kind == "purchase" else None,
        )
        found += [row] * random.choice([1, 1, 2])
    return found


@pytest.mark.parametrize("buffer", [5, 30, 500])
def test_after_every_batch_equal_to_the_whole_log(spark, tmp_path, buffer):
    panels = Panels(str(tmp_path), buffer).create(spark)
    sessions = spark.createDataFrame([(i, f"c{i % 2}", f"d{i}", "s") for i in range(1, 5)], "session_id long, country string, device string, source string")
    products = spark.createDataFrame([(1, "one"), (2, "two")], "product_id long, name string")
    all_rows = events(buffer)
    random.shuffle(all_rows)
    step = -(-len(all_rows) // 3)
    for batch_id in range(3):
        batch = click_log(spark, all_rows[batch_id * step : (batch_id + 1) * step])
        if batch_id == 2:
            panels.close(spark, 1)
        for _ in range(1 + batch_id % 2):
            panels.write(batch, batch_id)
        whole = click_log(spark, all_rows[: (batch_id + 1) * step]).cache()
        assert rows(panels.daily_kpis(spark)) == rows(daily.daily_kpis(whole))
        assert rows(panels.active_countries(spark, sessions)) == rows(daily.active_countries(whole, sessions))
        assert rows(panels.device_source(spark, sessions)) == rows(daily.device_source(whole, sessions))
        for scope in (("year",), ("month", 2024), ("day", 2024, 1), ("hour", 2024, 1, 2)):
            assert rows(panels.sales_trend(spark, *scope)) == rows(sales.sales_trend(whole, *scope))
        assert rows(panels.sales_filters(spark)) == rows(sales.sales_filters(whole))
        expected = live.live_top_products(whole, products, buffer)
        assert rows(panels.live_top_products(spark, products)) == rows(expected)


def test_empty_panels(spark, tmp_path):
    panels = Panels(str(tmp_path)).create(spark)
    assert rows(panels.daily_kpis(spark)) == [(0, 0, 0, 0.0, None)]
    assert panels.sales_trend(spark, "year").count() == panels.live_feed(spark).count() == 0


def test_a_poll_reads_its_day_alone(spark, tmp_path):
    panels = Panels(str(tmp_path)).create(spark)
    for day in range(4):
        panels.write(click_log(spark, [(day, 1, 2, "purchase", f"2024-01-0{day + 1} 10:00:00", 1, 5.0)]), day)
    panels.close(spark, 3)
    kpis = panels.daily_kpis(spark)
    assert rows(kpis, "total_events") == [(1,)]
    plan = plan_of(kpis)
    assert "PartitionFilters: [" in plan and "event_date#" in plan
    trend = plan_of(panels.sales_trend(spark, "hour", 2024, 1, 2))
    assert "event_date" in trend


def test_the_job_feeds_the_panels(spark, tmp_path):
    feed = Feed(spark, tmp_path / "feed")
    for number in range(3):
        feed.send(landed(number, f"2024-01-0{number + 1}T10:00:00", kind="purchase", session_id=7, amount_usd=2 + number))
    panels = Panels(str(tmp_path / "panels"))
    drain(panels.job(feed.stream(), close_every=2))
    assert rows(panels.daily_kpis(spark), "total_events", "purchases") == [(1, 1)]
    # The session's sale has moved to its last day.
    trend = panels.sales_trend(spark, "day", 2024, 1)
    assert [(str(r.period)[:10], r.order_count, float(r.revenue)) for r in trend.collect()] == [("2024-01-03", 1, 4.0)]
    assert len(rows(panels.live_feed(spark))) == 3


NAMES = ["Red Lamp", "lamplight", "la mp", "LAMPE", "über-Lamp", "a%b_c", "", None, "ringing ring", "xx"]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    chance = random.Random(3)
    stock = NAMES + ["".join(chance.choices("abcd ", k=chance.randint(0, 14))) for _ in range(300)]
    rows_ = [(i, name, chance.choice(["home", "Lamps", "abcab", None]), float(i)) for i, name in enumerate(stock)]
    products = spark.createDataFrame(rows_, "product_id long, name string, category string, price_usd double")
    path = str(tmp_path_factory.mktemp("index") / "grams")
    search.write_search_index(products, path)
    return products, spark.read.parquet(path)


def queries():
    chance = random.Random(4)
    return ["lamp", "LAMP", "am", "", "ÜBER", "a%b", "b_c", "p l", "mps", "zzz", "ring", "\\%"] + [
        "".join(chance.choices("abcd ", k=chance.randint(3, 6))) for _ in range(12)
    ]


@pytest.mark.parametrize("few", [2, 1_000])
def test_indexed_search_equals_the_scan(shop, few, monkeypatch):
    monkeypatch.setattr(search, "FEW", few)
    products, index = shop
    for query in queries():
        assert rows(search.indexed_search(products, index, query)) == rows(search.product_search(products, query)), query


def test_the_index_is_read_by_gram(spark, shop):
    _, index = shop
    candidates = search.search_candidates(index, "lamp")
    assert "PushedFilters: [In(gram, [amp,lam]" in plan_of(candidates) or "PushedFilters: [In(gram, [lam,amp]" in plan_of(candidates)
    everything = index.count()
    touched = index.filter(F.col("gram").isin("lam", "amp")).count()
    assert touched < everything / 4
    for undecided in ("la", "", "l%mp", "l_mp", "lam\\p"):
        assert search.search_candidates(index, undecided) is None
