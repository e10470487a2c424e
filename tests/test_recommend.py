from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import interactions, recommend
from clickloom.schemas import EVENTS, SESSIONS
from clickloom.sources.staging import Staging
from frames import at, rows

PAIRS = "user_id long, product_id long, interaction_score long"


def brute_force(pairs: list[tuple[int, int, int]], n: int) -> set[tuple[int, int, int, int]]:
    popularity: dict[int, int] = {}
    history: dict[int, set[int]] = {}
    for user, product, points in pairs:
        popularity[product] = popularity.get(product, 0) + points
        history.setdefault(user, set()).add(product)
    order = sorted(popularity, key=lambda p: (-popularity[p], p))
    found = set()
    for user, seen in history.items():
        unseen = [p for p in order if p not in seen][:n]
        found |= {(user, p, popularity[p], i + 1) for i, p in enumerate(unseen)}
    return found


def recommended(spark, pairs, n=5, **options):
    staging = Staging(spark)
    stored = staging.put(spark.createDataFrame(pairs, PAIRS), "pairs")
    return set(rows(recommend.recommend_unseen(stored, staging, n, **options)))


def random_pairs(seed: int, users: int, products: int) -> list[tuple[int, int, int]]:
    """Histories from a single product to the whole catalogue, popular ones preferred."""
    chance = random.Random(seed)
    pairs = {}
    for user in range(users):
        for _ in range(chance.choice([1, 3, 10, products])):
            product = min(int(chance.expovariate(5 / products)), products - 1)
            pairs[user, product] = chance.choice([0, 1, 3, 10])
    pairs |= {(users, p): 1 for p in range(products)}  # someone who has touched everything
    pairs |= {(users + 1, p): 1 for p in range(products) if p % 7}
    return [(*pair, points) for pair, points in pairs.items()]


@pytest.mark.parametrize(
    ("near_rows", "block"), [(200_000, 1_024), (200_000, 4), (10, 1_024), (10, 4), (0, 1)]
)
def test_unseen_equals_brute_force(spark, near_rows, block):
    for seed, n in [(1, 5), (2, 1), (3, 12)]:
        pairs = random_pairs(seed, 25, 60)
        found = recommended(spark, pairs, n, near_rows=near_rows, block=block)
        assert found == brute_force(pairs, n)


def test_only_long_histories_go_beyond_the_near_products(spark, monkeypatch):
    """One user has touched 300 products, the others a few far ones: of the rows that the near
    products do not answer, only the first user's go through the second shuffle."""
    pairs = [(0, p, 1) for p in range(300)] + [(u, 299 - u, 1) for u in range(1, 40)]
    pairs += [(u, p, 5) for u in range(100, 104) for p in range(20)]
    seen = []
    far_rows = recommend._far_rows

    def counting(*arguments):
        found = far_rows(*arguments)
        seen.append((arguments[0].count(), found.groupBy("user_id").count().collect()))
        return found

    monkeypatch.setattr(recommend, "_far_rows", counting)
    assert recommended(spark, pairs, 5, near_rows=50) == brute_force(pairs, 5)
    ((unanswered, sent),) = seen
    assert unanswered > 250 + 5 and [tuple(row) for row in sent] == [(0, 250)]


def test_ties_and_exhausted_users(spark):
    pairs = [(1, 10, 5), (2, 11, 5), (3, 10, 0), (3, 11, 0), (3, 12, 1)]
    assert recommended(spark, pairs, 5) == {
        (1, 11, 5, 1),
        (1, 12, 1, 2),
        (2, 10, 5, 1),
        (2, 12, 1, 2),
    }


def test_no_interactions(spark):
    assert recommended(spark, []) == set()


def test_places_are_global_across_partitions(spark):
    popularity = spark.range(1000).select(
        F.col("id").alias("product_id"), (F.col("id") % 7).alias("popularity_score")
    )
    ranked = recommend.rank_products(popularity.repartition(5), Staging(spark))
    found = [p for p, _ in sorted(rows(ranked, "product_id", "place"), key=lambda r: r[1])]
    assert found == sorted(range(1000), key=lambda p: (-(p % 7), p))
    assert sorted(rows(ranked, "place")) == [(i,) for i in range(1, 1001)]


def test_one_history_is_spread_over_blocks(spark):
    """No group of the block table holds more than a block of a user's history."""
    history = spark.range(1, 5001).select(F.lit(1).alias("user_id"), F.col("id").alias("place"))
    found = recommend._unseen_places(history, 3, 6000, 100)
    assert sorted(rows(found)) == [(1, 5001, 1), (1, 5002, 2), (1, 5003, 3)]


def test_unseen_counts(spark):
    pairs = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (2, 12, 1)], PAIRS)
    assert sorted(rows(recommend.unseen_counts(pairs))) == [(1, 1), (2, 2)]


@pytest.fixture
def products(spark):
    return spark.createDataFrame(
        [(p, f"name {p}", "c") for p in range(10, 13)],
        "product_id long, name string, category string",
    )


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(
        [(1, 10, 4), (1, 11, 4), (1, 12, 3), (2, 12, 9), (2, 99, 50)],
        "user_id long, product_id long, popularity_score long",
    )


def test_recommend_top(scores, products):
    found = rows(recommend.recommend_top(scores, products, 2), "product_id", "score", "rank")
    assert found == [(12, 12, 1), (10, 4, 2)]


def test_recommend_per_user(scores, products):
    found = rows(recommend.recommend_user(scores, products, 1), "product_id", "score", "rank")
    assert found == [(10, 4, 1), (11, 4, 2), (12, 3, 3)]
    assert rows(recommend.recommend_user(scores, products, 2), "product_id") == [(12,)]
    assert rows(recommend.recommend_user(scores, products, 3)) == []
    everyone = recommend.recommend_all(scores, products, 1)
    assert sorted(rows(everyone, "user_id", "product_id")) == [(1, 10), (2, 12)]


def test_score_share(scores, products):
    shares = recommend.score_share(recommend.recommend_all(scores, products))
    found = rows(shares, "user_id", "product_id", "percent_of_best")
    assert sorted(found) == [(1, 10, 100), (1, 11, 100), (1, 12, 75), (2, 12, 100)]


@pytest.fixture
def sources(spark):
    events = spark.createDataFrame(
        [
            (1, 10, "page_view", at("2024-01-01"), *[None] * 4),
            (1, 10, "add_to_cart", at("2024-01-01"), *[None] * 4),
            (1, 10, "purchase", at("2024-01-01"), *[None] * 4),
            (1, None, "page_view", at("2024-01-01"), *[None] * 4),
            (9, 10, "checkout", at("2024-01-01"), *[None] * 4),
        ],
        EVENTS,
    )
    sessions = spark.createDataFrame([(1, 5, at("2024-01-01"), "m", "p", "DE")], SESSIONS)
    orders = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "order_id long, customer_id long")
    items = spark.createDataFrame(
        [(1, 10), (1, 10), (2, 11), (2, None)], "order_id long, product_id long"
    )
    return events, sessions, orders, items


def test_interactions(sources):
    """An order without lines, an event without a session: neither adds a null key."""
    pairs = interactions.interactions(*sources)
    assert sorted(rows(pairs)) == [(5, 10, 24), (6, 11, 10)]
    popularity = interactions.product_popularity(pairs)
    assert rows(interactions.top_products(popularity, 1)) == [(10, 24)]
    assert interactions.als_input(pairs).dtypes == [
        ("user_id", "int"),
        ("product_id", "int"),
        ("interaction_score", "float"),
    ]


def test_recommended_products_are_new_to_the_user(spark, sources):
    staging = Staging(spark)
    pairs = staging.put(interactions.interactions(*sources), "pairs")
    found = recommend.recommend_unseen(pairs, staging)
    assert sorted(rows(found)) == [(5, 11, 10, 1), (6, 10, 24, 1)]
    assert found.join(pairs, ["user_id", "product_id"]).count() == 0
