"""One declared schema per table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(9, 4)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CUSTOMERS = _struct(
    customer_id=T.LongType(),
    name=T.StringType(),
    email=T.StringType(),
    country=T.StringType(),
    age=T.IntegerType(),
    signup_date=T.StringType(),
    marketing_opt_in=T.BooleanType(),
)

PRODUCTS = _struct(
    product_id=T.LongType(),
    category=T.StringType(),
    name=T.StringType(),
    price_usd=MONEY,
    cost_usd=MONEY,
    margin_usd=MONEY,
)

ORDERS = _struct(
    order_id=T.LongType(),
    customer_id=T.LongType(),
    order_time=T.TimestampType(),
    payment_method=T.StringType(),
    discount_pct=RATE,
    subtotal_usd=MONEY,
    total_usd=MONEY,
    country=T.StringType(),
    device=T.StringType(),
    source=T.StringType(),
)

ORDER_ITEMS = _struct(
    order_id=T.LongType(),
    product_id=T.LongType(),
    unit_price_usd=MONEY,
    quantity=T.IntegerType(),
    line_total_usd=MONEY,
)

REVIEWS = _struct(
    review_id=T.LongType(),
    order_id=T.LongType(),
    product_id=T.LongType(),
    rating=T.IntegerType(),
    review_text=T.StringType(),
    review_time=T.TimestampType(),
)

SESSIONS = _struct(
    session_id=T.LongType(),
    customer_id=T.LongType(),
    start_time=T.TimestampType(),
    device=T.StringType(),
    source=T.StringType(),
    country=T.StringType(),
)

# The event file: what a session did, before it is joined to its session.
EVENTS = _struct(
    session_id=T.LongType(),
    product_id=T.LongType(),
    event_type=T.StringType(),
    timestamp=T.TimestampType(),
    qty=T.DoubleType(),
    cart_size=T.DoubleType(),
    amount_usd=T.DoubleType(),
    discount_pct=T.DoubleType(),
)

# event_date is the partition column of the stored log.
CLICK_LOG = _struct(
    event_id=T.LongType(),
    user_id=T.LongType(),
    product_id=T.LongType(),
    event_type=T.StringType(),
    timestamp=T.TimestampType(),
    session_id=T.LongType(),
    qty=MONEY,
    cart_size=MONEY,
    amount_usd=MONEY,
    discount_pct=RATE,
    event_date=T.DateType(),
)

USER_SCORES = _struct(
    user_id=T.LongType(),
    product_id=T.LongType(),
    popularity_score=T.LongType(),
)

RECOMMENDATIONS = _struct(
    user_id=T.LongType(),
    product_id=T.LongType(),
    popularity_score=T.LongType(),
    rank=T.IntegerType(),
)

INTERACTIONS = _struct(
    user_id=T.LongType(),
    product_id=T.LongType(),
    interaction_score=T.LongType(),
)

# The three fields the scorer reads from a message.
SCORER_MESSAGE = _struct(
    user_id=T.LongType(),
    product_id=T.LongType(),
    event_type=T.StringType(),
)

# A whole message. Every field arrives as untrusted text and is cast after parsing, so that
# one bad field can be named instead of losing the message.
RAW_MESSAGE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "event_id",
            "user_id",
            "product_id",
            "event_type",
            "timestamp",
            "qty",
            "cart_size",
            "amount_usd",
            "discount_pct",
            "session_id",
            "device",
            "source",
            "country",
            "start_time",
        )
    ]
)

STATIC_TABLES = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "reviews": REVIEWS,
}

LIVE_TABLES = {
    "sessions": SESSIONS,
    "user_click_logs": CLICK_LOG,
    "user_recommendations": USER_SCORES,
}

DERIVED_TABLES = {
    "user_product_interactions": INTERACTIONS,
    "unseen_recommendations": RECOMMENDATIONS,
}

# Keys are not enforced by Spark; the quality checks read them from here.
PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "reviews": ["review_id"],
    "sessions": ["session_id"],
    "user_click_logs": ["event_id"],
    "user_recommendations": ["user_id", "product_id"],
}

PARTITIONED_BY = {"user_click_logs": ["event_date"]}
