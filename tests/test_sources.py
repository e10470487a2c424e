from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.plans import etl
from clickloom.plans.dashboard import Dashboard, country_names, log_events
from clickloom.schemas import CLICK_LOG, CUSTOMERS, EVENTS, LIVE_TABLES, STATIC_TABLES
from clickloom.sources import catalog, files, jdbc, kafka, staging
from clickloom.streaming import jobs
from clickloom.streaming.lifecycle import drain
from plan_text import plan_of
from frames import at, click_log, rows

CSV = {
    "customers": " Customer_ID ,NAME,email,country,age,signup_date,marketing_opt_in\n"
    "1,Ann,a@x,DE,33,2023-01-01,true\n2,Bob,b@x,FR,old,2023-01-02,false\n",
    "products": "product_id,category,name,price_usd,cost_usd,margin_usd,colour\n"
    "10,home,lamp,5.5,2,3.5,red\n11,home,rug,7,nan,,blue\n12,toys,kite,1,1,0,green\n",
    "orders": "order_id,customer_id,order_time,payment_method,discount_pct,subtotal_usd,total_usd,"
    "country,device,source\n1,1,2024-01-01 10:00:00,card,0.1,5.5,5,DE,mobile,paid\n"
    "2,2,2024-01-02 10:00:00,card,,7,7,FR,mobile,paid\n",
    "order_items": "order_id,product_id,unit_price_usd,quantity,line_total_usd\n1,10,5.5,3,16.5\n",
    "reviews": "review_id,order_id,product_id,rating,review_text,review_time\n1,1,10,5,ok,2024-01-03\n",
    "sessions": "session_id,customer_id,start_time,device,source,country\n"
    "100,1,2024-01-01 09:00:00,mobile,paid,DE\n200,2,2024-01-01 09:00:00,desktop,paid,FR\n",
    "events": "timestamp,session_id,product_id,event_type,qty\n"
    "2024-01-01 09:01:00,100,11.0,page_view,NaN\n2024-01-01 09:02:00,200,12,checkout,2\n"
    "2024-01-01 09:03:00,300,12,checkout,\n",
}


@pytest.fixture
def csv_folder(tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


@pytest.fixture
def database(spark):
    name = "shop_test"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_csv_by_header_name_with_declared_types(spark, csv_folder):
    customers = files.read_csv(spark, f"{csv_folder}/customers.csv", CUSTOMERS)
    assert customers.schema == CUSTOMERS
    assert rows(customers, "customer_id", "name", "age", "marketing_opt_in") == [
        (1, "Ann", 33, True),
        (2, "Bob", None, False),
    ]
    events = files.read_csv(spark, f"{csv_folder}/events.csv", EVENTS)
    assert events.columns == EVENTS.names
    assert rows(events, "session_id", "timestamp", "qty", "amount_usd") == [
        (100, at("2024-01-01 09:01"), None, None),
        (200, at("2024-01-01 09:02"), 2.0, None),
        (300, at("2024-01-01 09:03"), None, None),
    ]


def test_seed_twice(spark, csv_folder, database):
    for _ in range(2):
        audit = etl.seed(spark, csv_folder, database)
        assert {name: (n, lost) for name, n, lost in rows(audit)} == {
            "customers": (2, {"age": 1}),
            "products": (3, {}),
            "orders": (2, {}),
            "order_items": (1, {}),
            "reviews": (1, {}),
        }
        for name, schema in STATIC_TABLES.items():
            assert catalog.table(spark, name, database).dtypes == [
                (f.name, f.dataType.simpleString()) for f in schema.fields
            ]
        for name in LIVE_TABLES:
            assert catalog.table(spark, name, database).count() == 0
    assert rows(catalog.table(spark, "products", database), "product_id", "cost_usd")[1] == (11, None)


def test_seed_reads_each_file_once(spark, csv_folder, database, monkeypatch):
    """Every row that a scan hands on is counted: rows of the files, each once, writing and audit
    together."""
    read, handed_on = etl.read_csv_text, spark.sparkContext.accumulator(0)

    def counting(session, path, *more):
        text = read(session, path, *more)

        def count(batches):
            for batch in batches:
                handed_on.add(batch.num_rows)
                yield batch

        return text.mapInArrow(count, text.schema)

    monkeypatch.setattr(etl, "read_csv_text", counting)
    audit = etl.seed(spark, csv_folder, database)
    assert handed_on.value == sum(n for _, n, _ in rows(audit)) == 9


def test_audit_equals_a_pass_of_its_own(spark, csv_folder):
    text = files.read_csv_text(spark, f"{csv_folder}/customers.csv")
    audit = files.LoadAudit(text, CUSTOMERS)
    audit.rows.write.format("noop").mode("overwrite").save()
    assert audit.report() == (2, dict(rows(files.lost_values(text, CUSTOMERS))))
    empty = files.LoadAudit(text.limit(0), CUSTOMERS)
    assert empty.rows.count() == 0 and empty.report()[0] == 0


def test_live_tables_append_and_truncate(spark, database):
    catalog.create_tables(spark, database)
    log = click_log(
        spark,
        [
            (1, 1, 10, "purchase", "2024-01-01 10:00", 100, 5.0),
            (2, 1, 10, "page_view", "2024-01-02 10:00", 100, None),
        ],
    )
    catalog.append_table(log, "user_click_logs", database)
    stored = catalog.table(spark, "user_click_logs", database)
    assert rows(stored.orderBy("event_id")) == rows(log)
    newest = spark.range(1).select(catalog.newest_day(spark, database=database).alias("day"))
    assert rows(newest) == [(date(2024, 1, 2),)]
    board = Dashboard.from_catalog(spark, database)
    assert rows(board.daily_stats(), "total_events", "purchases") == [(1, 0)]
    assert board.active_countries().count() == 0
    catalog.truncate_live_tables(spark, database)
    assert catalog.table(spark, "user_click_logs", database).count() == 0
    assert rows(Dashboard.from_catalog(spark, database).daily_stats(), "total_events") == [(0,)]


def test_tables_bucketed_alike_join_without_a_shuffle(spark, database):
    for name in ("orders", "order_items"):
        keyed = spark.range(100).withColumnRenamed("id", "order_id")
        catalog.replace_table(keyed, name, database, bucket_key="order_id", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders, items = (catalog.table(spark, n, database) for n in ("orders", "order_items"))
        joined = orders.join(items, "order_id")
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rebuild_recommendations_twice(spark, csv_folder, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        etl.rebuild_recommendations(spark, csv_folder, out, n=2)
        pairs = spark.read.parquet(f"{out}/{etl.INTERACTIONS_TABLE}")
        assert sorted(rows(pairs)) == [(1, 10, 10), (1, 11, 1), (2, 12, 7)]
        top = spark.read.parquet(f"{out}/{etl.RECOMMENDATIONS_TABLE}")
        assert sorted(rows(top)) == [(1, 12, 7, 1), (2, 10, 10, 1), (2, 11, 1, 2)]
    assert etl.matrix(spark, out).count() == 3


def test_quoted_csv_text_and_lost_values(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text('product_id,name,price\n1,"good, ""really"" good",2.5\n2,"two\nlines",dear\n3.0,,nan\nx,c,\n')
    schema = T.StructType([T.StructField("product_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
    assert rows(files.read_csv(spark, str(path), schema)) == [
        (1, 'good, "really" good', 2.5),
        (2, "two\nlines", None),
        (3, None, None),
        (None, "c", None),
    ]
    lost = files.lost_values(files.read_csv_text(spark, str(path)), schema)
    assert dict(rows(lost)) == {"product_id": 1, "name": 0, "price": 1}


def test_logged_events_take_one_path(spark, tmp_path):
    entries = spark.createDataFrame(
        [(1, 10, "purchase")], "user_id long, product_id long, event_type string"
    )
    log, feed = str(tmp_path / "log"), str(tmp_path / "feed")
    log_events(entries, log)
    assert rows(spark.read.schema(CLICK_LOG).parquet(log), "user_id", "event_type") == [
        (1, "purchase")
    ]
    log_events(entries, log, feed_path=feed)
    assert spark.read.schema(CLICK_LOG).parquet(log).count() == 1
    with pytest.raises(ValueError):
        log_events(entries)
    landed = str(tmp_path / "landed")
    jobs.sessions_table(landed).create(spark)
    drain(jobs.land(kafka.read_files(spark, feed), landed))
    assert rows(jobs.landed_log(spark, landed), "user_id", "event_type") == [(1, "purchase")]
    (text,) = rows(spark.read.text(feed))
    assert '"user_id":1' in text[0] and '"session_id":null' in text[0]


def test_parquet_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.range(3)
    files.append_parquet(frame, path)
    files.append_parquet(frame, path)
    assert spark.read.parquet(path).count() == 6
    files.replace_parquet(frame, path)
    assert spark.read.parquet(path).count() == 3


def test_topic_options():
    options = kafka.source_options("host:1", offsets_per_trigger=5)
    assert options["subscribe"] == "click_events"
    assert options["maxOffsetsPerTrigger"] == "5"
    assert options["failOnDataLoss"] == "true"
    assert kafka.source_options("host:1", fail_on_data_loss=False)["failOnDataLoss"] == "false"


def test_database_options_come_from_the_environment():
    connection = jdbc.connection_options({"JDBC_URL": "jdbc:x", "JDBC_USER": "u", "OTHER": "o"})
    assert connection == {"url": "jdbc:x", "user": "u"}
    options = jdbc.write_options(connection, "t")
    assert options["dbtable"] == "t" and options["batchsize"] == "1000"
    split = jdbc.read_options(connection, "t", jdbc.Split("id", 0, 100, 8))
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "8"
    assert "numPartitions" not in jdbc.read_options(connection, "t")
    assert jdbc.upsert_statement("scores", "staged", ["user_id", "product_id"], ["score"]) == (
        "INSERT INTO scores (user_id, product_id, score) SELECT user_id, product_id, score FROM staged "
        "ON CONFLICT (user_id, product_id) DO UPDATE SET score = EXCLUDED.score"
    )


def test_staging_uses_the_shared_folder_and_clears_up(spark, tmp_path):
    with staging.Staging(spark) as scratch:
        assert scratch.root.startswith(spark.conf.get("spark.checkpoint.dir"))
        kept = scratch.put(spark.range(5), "five")
        assert kept.count() == 5
        folder = scratch.root
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_country_names(spark):
    names = dict(rows(country_names(spark)))
    assert names["DE"] == "Germany" and len(names) == 41
    assert spark.range(1).select(F.lit(names["US"])).first()[0] == "United States of America"
