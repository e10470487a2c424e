"""The library's tables as views over the benchmark tables.

The benchmark data has events, customers, parts, orders and order lines, but no sessions,
devices or typed products in its events. Those are derived row by row from the given columns,
with whole-number arithmetic that any SQL engine evaluates alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.values import money
from clickloom.operators.cleaning import event_messages, to_values

EVENT_TYPES = {"view": "page_view", "click": "add_to_cart", "signup": "checkout"}
DEVICES = ("mobile", "desktop", "tablet")
SOURCES = ("organic", "paid", "email", "direct", "social")
# A session's id is its user's number and its day, which has room for every day of the calendar.
FIRST_DAY = "0001-01-01"
DAYS = 10_000_000
# One defect per reason for which a message is rejected: the field and what stands in it.
DEFECTS = {
    "bad_json": (None, None),
    "missing_user_id": ("user_id", None),
    "bad_user_id": ("user_id", "n/a"),
    "missing_product_id": ("product_id", None),
    "bad_product_id": ("product_id", "11.5"),
    "missing_event_type": ("event_type", None),
    "bad_session_id": ("session_id", "n/a"),
    "bad_timestamp": ("timestamp", "yesterday"),
    "bad_start_time": ("start_time", "2024-13-01"),
    "bad_qty": ("qty", "many"),
    "bad_cart_size": ("cart_size", "1,5"),
    "bad_amount_usd": ("amount_usd", "$5"),
    "bad_discount_pct": ("discount_pct", "5 %"),
}


def _pick(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


class Canonical:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._given: dict[str, DataFrame] = {}

    def given(self, name: str) -> DataFrame:
        if name not in self._given:
            self._given[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._given[name]

    def customers(self) -> DataFrame:
        nations = self.given("nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
        )
        return (
            self.given("customer")
            .join(nations, "c_nationkey", "left")
            .select(
                F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), "country"
            )
        )

    def country_names(self) -> DataFrame:
        """Display names for most countries; the others fall back to their code."""
        regions = self.given("region")
        return (
            self.given("nation")
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
            .filter(F.col("n_nationkey") % 5 != 0)
            .select(
                F.col("n_name").alias("country"),
                F.concat_ws(", ", "n_name", "r_name").alias("display_name"),
            )
        )

    def products(self) -> DataFrame:
        return self.given("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            money(F.col("p_retailprice")).alias("price_usd"),
        )

    def orders(self) -> DataFrame:
        return self.given("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("timestamp").alias("order_time"),
            money(F.col("o_totalprice")).alias("total_usd"),
        )

    def order_items(self) -> DataFrame:
        return self.given("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            money(F.col("l_extendedprice")).alias("line_total_usd"),
        )

    def click_log(self) -> DataFrame:
        """Typed events. Their properties are one flat JSON object, `{"k": 76}`; a pattern
        takes the number out at less than half the price of a JSON parse, which matters
        because Spark evaluates it once more for each filter it pushes down."""
        types = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in EVENT_TYPES.items())
        typed = self.given("events").selectExpr(
            "event_id",
            "user_id",
            r"""try_cast(regexp_extract(props, r'"k"\s*:\s*(-?\d+)', 1) AS BIGINT) AS product_id""",
            f"CASE event_type {types} ELSE event_type END AS event_type",
            "CAST(ts AS TIMESTAMP) AS timestamp",
            "value",
            "to_date(CAST(ts AS TIMESTAMP)) AS event_date",
        )
        return typed.selectExpr(
            "event_id",
            "user_id",
            "product_id",
            "event_type",
            "timestamp",
            f"user_id * {DAYS} + date_diff(event_date, DATE '{FIRST_DAY}') AS session_id",
            """CAST(CASE WHEN event_type IN ('add_to_cart', 'purchase') THEN product_id % 3 + 1 END
                AS DECIMAL(18,2)) AS qty""",
            """CAST(CASE WHEN event_type = 'checkout' THEN product_id % 5 + 1 END
                AS DECIMAL(18,2)) AS cart_size""",
            "CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS amount_usd",
            """CAST(CASE WHEN event_type = 'purchase' THEN (product_id % 4) * 0.05 END
                AS DECIMAL(9,4)) AS discount_pct""",
            "event_date",
        )

    def session_owners(self) -> DataFrame:
        """A session is a user's day."""
        return (
            self.click_log()
            .groupBy("session_id", F.col("user_id").alias("customer_id"))
            .agg(F.min("timestamp").alias("start_time"))
        )

    def session_origins(self) -> DataFrame:
        """Device and source follow from user and day together, each in its own way."""
        number = F.col("session_id")
        other = F.floor(F.col("customer_id") / 3) + number
        return self.session_owners().withColumns(
            {"device": _pick(DEVICES, number), "source": _pick(SOURCES, other)}
        )

    def recorded_sessions(self) -> DataFrame:
        """Sessions as recorded: some have no owner."""
        known = F.when(F.col("session_id") % 11 != 0, F.col("customer_id"))
        return self.session_owners().withColumn("customer_id", known)

    def feed_log(self) -> DataFrame:
        """The log as a live feed leaves it: some events without an id or a time, some twice."""
        log = self.click_log()
        timed = F.col("event_id") % 500 != 7
        numbered = F.col("event_id") % 3 != 0
        feed = log.select(
            *[
                F.when(numbered if name == "event_id" else timed, F.col(name)).alias(name)
                if name in ("event_id", "timestamp", "event_date")
                else F.col(name)
                for name in log.columns
            ],
            F.when(F.col("event_id") % 4 == 0, 2).otherwise(1).alias("copies"),
        )
        each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
        return feed.select(*log.columns, each).drop("copy")

    def sessions(self) -> DataFrame:
        """With the country of the customer."""
        people = self.customers().select("customer_id", "country")
        return (
            self.session_origins()
            .join(people, "customer_id", "left")
            .select("session_id", "customer_id", "start_time", "device", "source", "country")
        )

    def raw_events(self) -> DataFrame:
        """The event file before cleaning: padded types, none for views, not-a-numbers, and
        no product on cheap errors."""
        kind = F.col("event_type")
        cheap_error = (kind == "error") & (F.col("product_id") < 5)
        nan = F.lit(float("nan"))
        return self.click_log().select(
            "event_id",
            "session_id",
            F.when(~cheap_error, F.col("product_id").cast("double")).alias("product_id"),
            F.when(kind != "page_view", F.concat(F.lit("  "), kind, F.lit(" "))).alias("event_type"),
            "timestamp",
            *[
                F.coalesce(F.col(name).cast("double"), nan).alias(name)
                for name in ("qty", "cart_size", "amount_usd", "discount_pct")
            ],
        )

    def delivered(self) -> DataFrame:
        """Clicks as they arrive, with attributes that vary within a session. Errors play the
        events logged by hand: no session and nothing about it."""
        people = self.customers().select(F.col("customer_id").alias("user_id"), "country")
        by_hand = F.col("event_type") == "error"
        minutes = (F.col("event_id") % 10).cast("int")
        started = F.when(
            F.col("event_type") != "checkout", F.timestamp_add("MINUTE", -minutes, "timestamp")
        )
        attributes = {
            "session_id": F.col("session_id"),
            "device": F.when(F.col("event_id") % 4 != 0, _pick(DEVICES, F.col("event_id"))),
            "source": _pick(SOURCES, F.col("event_id")),
            "country": F.col("country"),
            "start_time": started,
        }
        return (
            self.click_log()
            .join(people, "user_id", "left")
            .withColumns({name: F.when(~by_hand, col) for name, col in attributes.items()})
        )

    def faulty_values(self) -> DataFrame:
        """Delivered messages, some errors with a defect that depends on their product."""
        messages = event_messages(self.delivered())
        number = F.when(F.col("event_type") == "error", F.floor(F.col("product_id") / 5))
        marked = messages.withColumn("defect", number)
        spoiled = {name: F.col(name).cast("string") for name, _ in DEFECTS.values() if name}
        for at, (name, content) in enumerate(DEFECTS.values()):
            if name:
                kept = F.when(F.coalesce(F.col("defect") != at, F.lit(True)), spoiled[name])
                spoiled[name] = kept.otherwise(F.lit(content).cast("string"))
        cut = F.col("defect") == list(DEFECTS).index("bad_json")
        text = F.to_json(F.struct(*messages.columns))
        return marked.withColumns(spoiled).select(
            F.when(cut, F.substring(text, 1, 20)).otherwise(text).alias("value")
        )


def values_of(clicks: DataFrame) -> DataFrame:
    return to_values(event_messages(clicks))
