"""Product search."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.values import money
from clickloom.sources.files import replace_parquet

# Letters of an index entry, and products up to which the found ones are looked up by id.
GRAM = 3
FEW = 1_000


def product_search(
    products: DataFrame,
    query: str,
    min_price: float = 0,
    max_price: float = 1e9,
    limit: int = 20,
) -> DataFrame:
    """Case-insensitive substring in name or category within a price range, both ends
    included. `%` and `_` in the query are wildcards. A name hit outranks a category hit."""
    pattern = f"%{query}%"
    in_name = F.col("name").ilike(pattern)
    in_category = F.col("category").ilike(pattern)
    price = money(F.col("price_usd"))
    hits = products.filter(
        (in_name | in_category)
        & price.between(F.lit(Decimal(str(min_price))), F.lit(Decimal(str(max_price))))
    )
    return (
        hits.select(
            "product_id",
            "name",
            "category",
            price.cast("double").alias("price"),
            F.when(in_name, 3.0).when(in_category, 2.0).otherwise(1.0).alias("score"),
        )
        .orderBy(F.desc("score"), "price", "product_id")
        .limit(limit)
    )


def _grams(text: Column) -> Column:
    """The distinct stretches of GRAM letters of a text in lower case, as ILIKE compares it."""
    lower = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(lower) - (GRAM - 1), F.lit(1)))
    stretches = F.transform(starts, lambda i: F.substr(lower, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(stretches, lambda gram: F.length(gram) == GRAM))


def write_search_index(products: DataFrame, path: str) -> None:
    """(gram, field, product_id) for names and categories, sorted by gram, so that a search for a few
    grams skips nearly all of it by the files' own statistics."""
    entries = [
        products.select(F.explode(_grams(F.col(field))).alias("gram"), F.lit(field).alias("field"), "product_id")
        for field in ("name", "category")
    ]
    index = entries[0].unionByName(entries[1])
    replace_parquet(index.repartitionByRange("gram", "product_id").sortWithinPartitions("gram", "product_id"), path)


def search_candidates(index: DataFrame, query: str) -> DataFrame | None:
    """product_id of all whose name or category has every gram of the query. None where grams do not
    decide: a query with wildcards or an escape, or shorter than a gram."""
    if set(query) & set("%_\\"):
        return None
    spark = index.sparkSession
    grams = spark.range(1).select(_grams(F.lit(query)).alias("grams")).first().grams
    if not grams:
        return None
    found = index.filter(F.col("gram").isin(*grams)).groupBy("product_id", "field").agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") == len(grams)).select("product_id").distinct()


def indexed_search(
    products: DataFrame,
    index: DataFrame,
    query: str,
    min_price: float = 0,
    max_price: float = 1e9,
    limit: int = 20,
) -> DataFrame:
    """`product_search` over the products that the index leaves; the same result. A few candidates
    are looked up by id, which reaches the scan; more are joined."""
    candidates = search_candidates(index, query)
    if candidates is not None:
        few = [row.product_id for row in candidates.limit(FEW + 1).collect()]
        if len(few) <= FEW:
            products = products.filter(F.col("product_id").isin(few))
        else:
            products = products.join(candidates, "product_id", "left_semi")
    return product_search(products, query, min_price, max_price, limit)
