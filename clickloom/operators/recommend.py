"""Rankings of products a user already knows, and of popular ones still unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.values import rounded_percent
from clickloom.operators.interactions import product_popularity
from clickloom.sources.staging import Staging

# --- products a user has interacted with (live scores) -------------------------------------


def _named(scores: DataFrame, products: DataFrame) -> DataFrame:
    return scores.join(products.select("product_id", "name", "category"), "product_id")


def recommend_top(scores: DataFrame, products: DataFrame, limit: int = 200) -> DataFrame:
    """Products by total score over all users. Names are joined to one row per product, and
    the position is numbered over the `limit` rows that are left."""
    totals = scores.groupBy("product_id").agg(F.sum("popularity_score").alias("score"))
    top = _named(totals, products).orderBy(F.desc("score"), "product_id").limit(limit)
    position = F.row_number().over(Window.orderBy(F.desc("score"), "product_id"))
    return top.select("product_id", "name", "category", "score", position.alias("rank"))


def recommend_all(scores: DataFrame, products: DataFrame, limit: int = 20) -> DataFrame:
    """Each user's products by score; `scores` has one row per pair. Spark cuts to `limit`
    rows per user within each task before the shuffle, so a user with very many products
    does not fill one task."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "product_id")
    return (
        _named(scores.withColumnRenamed("popularity_score", "score"), products)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("user_id", "product_id", "name", "category", "score", "rank")
    )


def recommend_user(
    scores: DataFrame, products: DataFrame, user_id: int, limit: int = 20
) -> DataFrame:
    """One user's list. The filter reaches the stored scores (or the log behind them)."""
    mine = scores.filter(F.col("user_id") == user_id)
    return recommend_all(mine, products, limit).orderBy("rank")


def score_share(ranked: DataFrame) -> DataFrame:
    """Score as a whole percentage of the user's best one; `ranked` is bounded per user."""
    best = F.max("score").over(Window.partitionBy("user_id"))
    return ranked.withColumn("best", best).select(
        "user_id",
        "product_id",
        "score",
        "rank",
        rounded_percent(F.col("score"), F.col("best")).alias("percent_of_best"),
    )


# --- popular products a user has not touched -----------------------------------------------

# The best-placed products, which most users and most rows refer to, are joined by broadcast;
# this many rows of three longs are a few megabytes. Everything beyond is shuffled.
BROADCAST_ROWS = 200_000

# Ranks are worked on in blocks, so that no user's history is ever one group.
BLOCK = 1_024

# Tasks that the far rows of one user with a very long history are dealt out to.
SALTS = 32


def rank_products(popularity: DataFrame, staging: Staging) -> DataFrame:
    """A global position for every product: popularity down, then id.

    No task sees all products: they are range-partitioned in that order, numbered within
    their partition, written, and each partition's start is added from the partition sizes.
    """
    order = (F.desc("popularity_score"), F.asc("product_id"))
    numbered = staging.put(
        popularity.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("position", F.monotonically_increasing_id()),
        "ordered-products",
    )
    # The id carries the partition number in its upper bits, the row number in the lower 33.
    part = F.shiftright("position", 33)
    row = F.col("position").bitwiseAND((1 << 33) - 1)
    placed = numbered.select("product_id", "popularity_score", part.alias("part"), row.alias("row"))
    # One row per partition.
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = placed.join(F.broadcast(starts), "part").select(
        "product_id", "popularity_score", (F.col("start") + F.col("row") + 1).alias("place")
    )
    return staging.put(ranked, "ranked-products")


def _join_places(
    rows: DataFrame, ranked: DataFrame, key: str, wanted: list[str], reach: int, near_rows: int
) -> DataFrame:
    """Left join to the products placed up to `reach`.

    The near ones, at most `near_rows` and the ones most rows refer to, are broadcast. When
    `reach` is farther, the rest is joined by shuffle.
    """

    def part(low: int, high: int, suffix: str) -> DataFrame:
        inside = ranked.filter((F.col("place") > low) & (F.col("place") <= high))
        return inside.select(
            F.col(key).alias(f"key{suffix}"), *[F.col(c).alias(f"{c}{suffix}") for c in wanted]
        )

    near = F.broadcast(part(0, min(reach, near_rows), "_near"))
    joined = rows.join(near, F.col(key) == F.col("key_near"), "left")
    found: dict[str, Column] = {c: F.col(f"{c}_near") for c in wanted}
    if reach > near_rows:
        # Rows that are done go to partitions by a hash of themselves, not by their (hot) key
        # or by one null; should the hash be someone's key, the near value still wins.
        rest = F.when(F.col("key_near").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
        joined = joined.withColumn("rest", rest)
        joined = joined.join(
            part(near_rows, reach, "_far"), F.col("rest") == F.col("key_far"), "left"
        )
        found = {c: F.coalesce(f"{c}_near", f"{c}_far") for c in wanted}
    return joined.select(*rows.columns, *[col.alias(c) for c, col in found.items()])


def _interval(first: Column, last: Column, skipped: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"), skipped.alias("skipped"))


def _unseen_places(history: DataFrame, n: int, n_products: int, block: int) -> DataFrame:
    """(user_id, place, rank): the first `n` places missing from each user's history.

    `history` has distinct (user_id, place); place is null for a product out of reach. With
    the places sorted, the k-th one at place p has p - k missing places before it, so the
    first `n` gaps follow from the history alone: the work grows with the history, and no
    user is paired with the products. A block's places are at most `block` values; a user's
    blocks are numbered by count, not by row.
    """
    place = F.col("place")
    blocks = history.groupBy(
        "user_id", F.coalesce(F.floor((place - 1) / block), F.lit(-1)).alias("block")
    ).agg(F.sort_array(F.collect_list(place)).alias("seen"))

    # The windows over a user's blocks carry counts alone; the places stay with their block.
    counts = history.groupBy(
        "user_id", F.coalesce(F.floor((place - 1) / block), F.lit(-1)).alias("block")
    ).agg(F.count(place).alias("n_seen"))
    by_block = Window.partitionBy("user_id").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("block") * block  # places before this block
    numbered = counts.select(
        "user_id",
        "block",
        start.alias("start"),
        F.least(start + block, F.lit(n_products)).alias("end"),
        F.coalesce(F.sum("n_seen").over(earlier), F.lit(0)).alias("seen_before"),
        "n_seen",
        F.coalesce(F.lag("block").over(by_block) + 1, F.lit(0)).alias("next_free"),
        F.lead("block").over(by_block).isNull().alias("is_last"),
    )
    positioned = numbered.join(blocks, ["user_id", "block"])

    # Whole blocks without history: before this one, and after the user's last one.
    gap_before = _interval(
        F.col("next_free") * block + 1,
        F.col("start"),
        F.col("next_free") * block - F.col("seen_before"),
    )
    gap_after = _interval(
        F.greatest("end", F.lit(0)) + 1,
        F.when(F.col("is_last"), F.lit(n_products)).otherwise(F.lit(0)),
        F.greatest("end", F.lit(0)) - F.col("seen_before") - F.col("n_seen"),
    )
    # Between one seen place and the next within the block; the edges stand in at both ends.
    edges = F.concat(F.array(F.col("start")), F.col("seen"))
    following = F.concat(F.col("seen"), F.array(F.col("end") + 1))
    between = F.zip_with(
        edges, following, lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    )
    in_block = F.transform(
        between,
        lambda pair, i: _interval(
            pair["low"] + 1, pair["high"] - 1, pair["low"] - F.col("seen_before") - i
        ),
    )

    gaps = F.filter(
        F.concat(F.array(gap_before, gap_after), in_block),
        lambda gap: (gap["first"] >= 1)
        & (gap["first"] <= gap["last"])
        & (gap["skipped"] < n),
    )
    places = positioned.select("user_id", F.inline(gaps)).select(
        "user_id",
        "skipped",
        F.posexplode(
            F.sequence("first", F.least("last", F.col("first") + (n - 1) - F.col("skipped")))
        ).alias("offset", "place"),
    )
    rank = (F.col("skipped") + F.col("offset") + 1).cast("int")
    return places.select("user_id", "place", rank.alias("rank"))


def _far_rows(rows: DataFrame, heavy: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of users in `heavy`. A heavy user's rows are dealt out by a hash of the product."""
    salt = F.pmod(F.xxhash64("product_id"), F.lit(salts)).cast("int")
    spread = heavy.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return rows.withColumn("salt", salt).join(spread, ["user_id", "salt"], "left_semi").drop("salt")


def _history_places(
    pairs: DataFrame, ranked: DataFrame, per_user: DataFrame, n: int, reach: int, near_rows: int, staging: Staging
) -> DataFrame:
    """(user_id, place) of the products in each history, as far as that user's answer can depend on
    them: a user with h products asks for the first n + h places.

    The near products are joined by broadcast. Whoever asks for no more than those is done: the rest
    of such a history lies beyond the answer and goes no further. Only users who ask for more send
    their remaining rows through a shuffle. Every user has one row without a place, so that none is
    lost whose whole history is far."""
    near = F.broadcast(ranked.filter(F.col("place") <= min(reach, near_rows)).select("product_id", "place"))
    if reach <= near_rows:
        return pairs.select("user_id", "product_id").join(near, "product_id", "left").select("user_id", "place")
    joined = pairs.select("user_id", "product_id").join(near, "product_id", "left")
    heavy = staging.put(per_user.filter(F.col("h") + n > near_rows).select("user_id"), "heavy-users")
    rest = _far_rows(joined.filter(F.col("place").isNull()).drop("place"), heavy)
    far = ranked.filter((F.col("place") > near_rows) & (F.col("place") <= reach)).select("product_id", "place")
    everyone = per_user.select("user_id", F.lit(None).cast("long").alias("place"))
    found = joined.filter(F.col("place").isNotNull()).select("user_id", "place")
    return found.unionByName(rest.join(far, "product_id").select("user_id", "place")).unionByName(everyone)


def recommend_unseen(
    pairs: DataFrame,
    staging: Staging,
    n: int = 5,
    near_rows: int = BROADCAST_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """Each user's `n` most popular products without an interaction.

    `pairs` is a stored table of interactions, one row per pair; it is read several times.
    Popularity order is the same for everybody, so a user with h products finds the answer
    among the first n + h places. The ranking is written to `staging`; the only values the
    driver sees are two counts.
    """
    ranked = rank_products(product_popularity(pairs), staging)
    n_products = ranked.count()
    per_user = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
    longest = per_user.agg(F.max("h")).first()[0] or 0
    reach = min(n + longest, n_products)
    history = _history_places(pairs, ranked, per_user, n, reach, near_rows, staging)
    places = _unseen_places(history, n, n_products, block)
    named = _join_places(
        places, ranked, "place", ["product_id", "popularity_score"], reach, near_rows
    )
    return named.select("user_id", "product_id", "popularity_score", "rank")


def unseen_counts(pairs: DataFrame) -> DataFrame:
    """How many products each user has yet to touch; `pairs` as above. Every product in a
    history is in the catalogue of interactions, so this is a subtraction, not a product of
    the two."""
    catalogue = pairs.select("product_id").distinct().agg(F.count("product_id")).scalar()
    touched = pairs.groupBy("user_id").agg(F.count("product_id").alias("n_touched"))
    return touched.select("user_id", (catalogue - F.col("n_touched")).alias("n_candidates"))
