"""Batch jobs: seed the tables from CSV files, and rebuild the recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.operators.interactions import als_input, interactions
from clickloom.operators.recommend import recommend_unseen
from clickloom.schemas import (
    EVENTS,
    INTERACTIONS,
    ORDER_ITEMS,
    ORDERS,
    RECOMMENDATIONS,
    SESSIONS,
    STATIC_TABLES,
)
from clickloom.session import use_utc
from clickloom.sources.catalog import create_tables, replace_table, truncate_live_tables
from clickloom.sources.files import LoadAudit, read_csv, read_csv_text, replace_parquet
from clickloom.sources.staging import Staging

INTERACTIONS_TABLE = "user_product_interactions"
RECOMMENDATIONS_TABLE = "unseen_recommendations"


def seed(spark: SparkSession, folder: str, database: str = "default") -> DataFrame:
    """Create the tables, replace the static ones from CSV and empty the live ones. Every file is read
    once: (table_name, n_rows, lost) are counted while its table is written. `lost` maps the columns
    that had values which do not parse, and are now null, to their number."""
    use_utc(spark)
    create_tables(spark, database)
    report = []
    for name, schema in STATIC_TABLES.items():
        audit = LoadAudit(read_csv_text(spark, f"{folder}/{name}.csv"), schema)
        replace_table(audit.rows, name, database)
        n_rows, lost = audit.report()
        report.append((name, n_rows, {column: n for column, n in lost.items() if n}))
    truncate_live_tables(spark, database)
    return spark.createDataFrame(report, "table_name string, n_rows long, lost map<string, long>")


def rebuild_recommendations(
    spark: SparkSession, folder: str, out: str, n: int = 5, events_file: str = "events.csv"
) -> None:
    """Interactions from events and orders, then each user's popular unseen products. Both
    tables are replaced, so a second run gives the same result."""
    use_utc(spark)
    pairs = interactions(
        read_csv(spark, f"{folder}/{events_file}", EVENTS),
        read_csv(spark, f"{folder}/sessions.csv", SESSIONS),
        read_csv(spark, f"{folder}/orders.csv", ORDERS),
        read_csv(spark, f"{folder}/order_items.csv", ORDER_ITEMS),
    )
    replace_parquet(pairs, f"{out}/{INTERACTIONS_TABLE}")
    stored = spark.read.schema(INTERACTIONS).parquet(f"{out}/{INTERACTIONS_TABLE}")
    with Staging(spark) as staging:
        top = recommend_unseen(stored, staging, n).select(*RECOMMENDATIONS.names)
        replace_parquet(top, f"{out}/{RECOMMENDATIONS_TABLE}")


def matrix(spark: SparkSession, out: str) -> DataFrame:
    """The stored interactions as input for a factorisation model."""
    return als_input(spark.read.schema(INTERACTIONS).parquet(f"{out}/{INTERACTIONS_TABLE}"))
