"""Small inline frames for the tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.values import money
from clickloom.schemas import CLICK_LOG

MINIMAL = "event_id long, user_id long, product_id long, event_type string, timestamp timestamp, \
session_id long, amount_usd double"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def click_log(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (event_id, user, product, type, time text, session, amount)."""
    timed = [(*r[:4], at(r[4]) if r[4] else None, *r[5:]) for r in rows]
    frame = spark.createDataFrame(timed, MINIMAL).withColumns(
        {
            "amount_usd": money(F.col("amount_usd")),
            "event_date": F.to_date("timestamp"),
            **{c: F.lit(None).cast("decimal(18,2)") for c in ("qty", "cart_size")},
            "discount_pct": F.lit(None).cast("decimal(9,4)"),
        }
    )
    return frame.select(*CLICK_LOG.names)


def rows(frame: DataFrame, *columns: str) -> list[tuple]:
    chosen = frame.select(*columns) if columns else frame
    return [tuple(r) for r in chosen.collect()]


def values(spark: SparkSession, *texts: str | None) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "value string")
