"""Independent SQL for every query in the catalogue, over the benchmark tables.

Written for a different engine and in the most direct form (full products of users and
products, plain windows), so that it checks the shortcuts the operators take.
"""

from __future__ import annotations

# Views over the given tables, in the order they depend on each other.
VIEWS = {
    "click_log": """
        SELECT event_id, user_id, product_id, event_type, timestamp, session_id,
            CAST(CASE WHEN event_type IN ('add_to_cart', 'purchase')
                THEN product_id % 3 + 1 END AS DOUBLE) AS qty,
            CAST(CASE WHEN event_type = 'checkout' THEN product_id % 5 + 1 END AS DOUBLE)
                AS cart_size,
            CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS amount_usd,
            CAST(CASE WHEN event_type = 'purchase'
                THEN CAST((product_id % 4) * 5 AS DECIMAL(9,4)) / 100 END AS DOUBLE)
                AS discount_pct,
            event_date
        FROM (
            SELECT event_id, user_id, value, ts AS timestamp, CAST(ts AS DATE) AS event_date,
                CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
                CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
                    WHEN 'signup' THEN 'checkout' ELSE event_type END AS event_type,
                user_id * 10000000 + date_diff('day', DATE '0001-01-01', CAST(ts AS DATE))
                    AS session_id
            FROM events)""",
    "people": """
        SELECT c_custkey AS customer_id, c_name AS name, n_name AS country
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "products": """
        SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
            CAST(p_retailprice AS DECIMAL(18,2)) AS price_usd
        FROM part""",
    "sessions": """
        SELECT session_id, g.customer_id, start_time, country,
            CASE session_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END
                AS device,
            CASE (g.customer_id // 3 + session_id) % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid'
                WHEN 2 THEN 'email' WHEN 3 THEN 'direct' ELSE 'social' END AS source
        FROM (
            SELECT session_id, user_id AS customer_id, min(timestamp) AS start_time
            FROM click_log GROUP BY ALL) g
        LEFT JOIN people p ON p.customer_id = g.customer_id""",
    "scored": """
        SELECT *,
            CASE event_type WHEN 'page_view' THEN 1 WHEN 'add_to_cart' THEN 5
                WHEN 'checkout' THEN 7 WHEN 'purchase' THEN 10 ELSE 1 END AS live,
            CASE event_type WHEN 'page_view' THEN 1 WHEN 'add_to_cart' THEN 3
                WHEN 'checkout' THEN 7 ELSE 0 END AS batch
        FROM click_log""",
    "feed": """
        SELECT l.* REPLACE (
            CASE WHEN event_id % 3 <> 0 THEN event_id END AS event_id,
            CASE WHEN event_id % 500 <> 7 THEN timestamp END AS timestamp,
            CASE WHEN event_id % 500 <> 7 THEN event_date END AS event_date)
        FROM (SELECT * FROM scored UNION ALL SELECT * FROM scored WHERE event_id % 4 = 0) l""",
    "feed_once": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, product_id, timestamp
                ORDER BY event_id NULLS LAST, event_type, session_id) AS rn
            FROM feed)
        WHERE rn = 1""",
    "delivered": """
        SELECT l.* EXCLUDE (session_id),
            CASE WHEN event_type <> 'error' THEN session_id END AS session_id,
            CASE WHEN event_type <> 'error' AND event_id % 4 <> 0 THEN
                CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END
                END AS device,
            CASE WHEN event_type <> 'error' THEN
                CASE event_id % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid' WHEN 2 THEN 'email'
                    WHEN 3 THEN 'direct' ELSE 'social' END END AS source,
            CASE WHEN event_type <> 'error' THEN country END AS country,
            CASE WHEN event_type NOT IN ('error', 'checkout')
                THEN timestamp - to_minutes(event_id % 10) END AS start_time
        FROM click_log l LEFT JOIN people p ON p.customer_id = l.user_id""",
    "raw_events": """
        SELECT * EXCLUDE (product_id),
            CASE WHEN event_type = 'error' AND product_id < 5 THEN NULL ELSE product_id END
                AS product_id
        FROM click_log""",
    "pairs": """
        SELECT user_id, product_id, CAST(sum(points) AS BIGINT) AS interaction_score
        FROM (
            SELECT s.customer_id AS user_id, l.product_id, l.batch AS points
            FROM scored l JOIN sessions s ON l.session_id = s.session_id
            WHERE l.product_id IS NOT NULL
            UNION ALL
            SELECT o_custkey, l_partkey, 10
            FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
            WHERE l_partkey IS NOT NULL)
        GROUP BY user_id, product_id""",
    "popularity": """
        SELECT product_id, CAST(sum(interaction_score) AS BIGINT) AS popularity_score
        FROM pairs GROUP BY product_id""",
    "scores": """
        SELECT user_id, product_id, CAST(sum(live) AS BIGINT) AS popularity_score
        FROM scored GROUP BY user_id, product_id""",
    "ranked_scores": """
        SELECT s.user_id, s.product_id, p.name, p.category, s.popularity_score AS score,
            CAST(row_number() OVER (PARTITION BY s.user_id
                ORDER BY s.popularity_score DESC, s.product_id) AS INTEGER) AS rank
        FROM scores s JOIN products p ON s.product_id = p.product_id""",
    "today": """
        SELECT * FROM scored WHERE event_date = (SELECT max(event_date) FROM click_log)""",
    "active": """
        SELECT country, count(DISTINCT user_id) AS active_users
        FROM today JOIN sessions ON today.session_id = sessions.session_id
        GROUP BY country""",
    "traffic": """
        SELECT device, source, count(DISTINCT user_id) AS users, count(*) AS events
        FROM today JOIN sessions ON today.session_id = sessions.session_id
        GROUP BY device, source""",
    "sales": """
        SELECT * FROM click_log WHERE event_type = 'purchase' AND amount_usd IS NOT NULL""",
    "categories": """
        SELECT category, count(DISTINCT session_id) AS total_sessions, count(*) AS total_events,
            CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN amount_usd ELSE 0 END), 0)
                AS DECIMAL(18,2)) AS revenue
        FROM click_log JOIN products ON click_log.product_id = products.product_id
        GROUP BY category""",
}

_USES = {
    "sessions": ("click_log", "people"),
    "scored": ("click_log",),
    "feed": ("scored",),
    "feed_once": ("feed",),
    "delivered": ("click_log", "people"),
    "raw_events": ("click_log",),
    "pairs": ("scored", "sessions"),
    "popularity": ("pairs",),
    "scores": ("scored",),
    "ranked_scores": ("scores", "products"),
    "today": ("scored",),
    "active": ("today", "sessions"),
    "traffic": ("today", "sessions"),
    "sales": ("click_log",),
    "categories": ("click_log", "products"),
}


def _with(select: str, *views: str) -> str:
    needed: set[str] = set()
    pending = list(views)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending.extend(_USES.get(name, ()))
    parts = [f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in needed]
    return f"WITH {', '.join(parts)}\n{select}" if parts else select


LOG_COLUMNS = """CAST(event_id AS VARCHAR) AS event_id, user_id, product_id, event_type, timestamp,
    CAST(session_id AS VARCHAR) AS session_id, qty, cart_size,
    CAST(amount_usd AS DOUBLE) AS amount_usd, discount_pct, CAST(event_date AS VARCHAR)
        AS event_date"""


def _trend(unit: str, where: str) -> str:
    return f"""
        SELECT CAST(date_trunc('{unit}', sale_time) AS TIMESTAMP) AS period,
            count(*) AS order_count,
            CAST(CAST(sum(amount_usd) AS DECIMAL(18,2)) AS DOUBLE) AS revenue
        FROM (SELECT session_id, max(timestamp) AS sale_time, max(amount_usd) AS amount_usd
            FROM sales WHERE {where} GROUP BY session_id)
        GROUP BY period ORDER BY period"""


DAY_TREND = _trend("day", "year(timestamp) = 2024 AND month(timestamp) = 1")


def _tick(amount: str, condition: str) -> str:
    return f"""'$' || CASE WHEN {amount} {condition}
        THEN CAST(CAST(floor(({amount} + 500) / 1000) AS BIGINT) AS VARCHAR) || 'k'
        ELSE regexp_replace(CAST({amount} AS VARCHAR), '\\.?0+$', '') END"""


def _money_label(amount: str) -> str:
    fraction = f"regexp_extract(CAST({amount} AS VARCHAR), '\\.\\d\\d$')"
    return f"""'$' || format('{{:,}}', CAST(floor({amount}) AS BIGINT))
        || regexp_replace({fraction}, '\\.?0+$', '')"""


def _key_check(table: str, source: str, *key: str) -> str:
    columns = ", ".join(key)
    null = " OR ".join(f"{c} IS NULL" for c in key)
    return f"""
        SELECT '{table}' AS table_name, '{",".join(key)}' AS key_columns,
            CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows,
            CAST(coalesce(sum(n) FILTER (WHERE {null}), 0) AS BIGINT) AS null_keys,
            count(*) FILTER (WHERE n > 1 AND NOT ({null})) AS duplicate_keys
        FROM (SELECT {columns}, count(*) AS n FROM ({source}) GROUP BY {columns})"""


CLICK_SESSION_COLUMNS = """
    l.event_id, s.customer_id AS user_id, l.product_id, l.event_type, l.timestamp, l.qty,
    l.cart_size, CAST(l.amount_usd AS DOUBLE) AS amount_usd, l.discount_pct, l.session_id,
    s.device, s.source, s.country, s.start_time"""
CLICK_SESSIONS = """raw_events l JOIN sessions s ON l.session_id = s.session_id
    WHERE l.product_id IS NOT NULL AND s.customer_id IS NOT NULL"""

SESSIONS_FIRST = """
    SELECT session_id, user_id AS customer_id, coalesce(start_time, timestamp) AS start_time,
        coalesce(device, '') AS device, coalesce(source, '') AS source,
        coalesce(country, '') AS country
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS rn
        FROM delivered WHERE session_id IS NOT NULL)
    WHERE rn = 1"""

QUARANTINE = """
    SELECT reason, count(*) AS n_events
    FROM (SELECT CASE product_id // 5 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'missing_user_id'
            WHEN 2 THEN 'bad_user_id' WHEN 3 THEN 'missing_product_id' WHEN 4 THEN 'bad_product_id'
            WHEN 5 THEN 'missing_event_type' WHEN 6 THEN 'bad_session_id'
            WHEN 7 THEN 'bad_timestamp' WHEN 8 THEN 'bad_start_time' WHEN 9 THEN 'bad_qty'
            WHEN 10 THEN 'bad_cart_size' WHEN 11 THEN 'bad_amount_usd'
            WHEN 12 THEN 'bad_discount_pct' END AS reason
        FROM click_log WHERE event_type = 'error')
    WHERE reason IS NOT NULL GROUP BY reason"""

LABELS = "strftime(timestamp, '{}')"


# Queries that must give what another one gives, by a way of their own.
SAME_AS = {
    "product_search_indexed": "product_search",
    "panel_daily_kpis": "daily_kpis",
    "panel_device_source": "device_source",
    "panel_active_countries": "active_countries",
    "panel_sales_trend_day": "sales_trend_day",
    "panel_top_products": "live_top_products",
}


def oracle_sql() -> dict[str, str]:
    twins = _twins()
    return twins | {name: twins[other] for name, other in SAME_AS.items()}


def _twins() -> dict[str, str]:
    scores = _with("SELECT * FROM scores", "scores")
    sessions_first = _with(SESSIONS_FIRST, "delivered")
    dedup = f"""
        SELECT {LOG_COLUMNS} FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, product_id, timestamp
                ORDER BY event_id) AS rn
            FROM (SELECT * FROM {{0}} UNION ALL SELECT * FROM {{0}}))
        WHERE rn = 1"""
    return {
        "json_parse": """
            SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id
            FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""",
        "scorer_messages": _with(
            """SELECT user_id, product_id, event_type FROM click_log
            WHERE user_id IS NOT NULL AND product_id IS NOT NULL""",
            "click_log",
        ),
        "scored_live": _with(
            "SELECT event_id, event_type, CAST(live AS BIGINT) AS score FROM scored", "scored"
        ),
        "scored_batch": _with(
            "SELECT event_id, event_type, CAST(batch AS BIGINT) AS score FROM scored", "scored"
        ),
        "click_events": _with(
            f"SELECT {CLICK_SESSION_COLUMNS} FROM {CLICK_SESSIONS}", "raw_events", "sessions"
        ),
        "rejected_events": _with(
            """SELECT CASE WHEN s.customer_id IS NULL THEN 'missing_user'
                ELSE 'missing_product' END AS reason, count(*) AS n_events
            FROM raw_events l LEFT JOIN (
                SELECT session_id, CASE WHEN session_id % 11 <> 0 THEN customer_id END AS customer_id
                FROM sessions) s ON l.session_id = s.session_id
            WHERE s.customer_id IS NULL OR l.product_id IS NULL GROUP BY reason""",
            "raw_events",
            "sessions",
        ),
        "event_json": _with(
            f"""SELECT event_id, user_id, product_id, event_type,
                CAST(CASE event_type WHEN 'page_view' THEN 1 WHEN 'add_to_cart' THEN 5
                    WHEN 'checkout' THEN 7 WHEN 'purchase' THEN 10 ELSE 1 END AS BIGINT) AS score,
                strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
                qty, cart_size, amount_usd, discount_pct, session_id, device, source, country,
                strftime(start_time, '%Y-%m-%d %H:%M:%S.%f') AS start_time
            FROM (SELECT {CLICK_SESSION_COLUMNS} FROM {CLICK_SESSIONS})""",
            "raw_events",
            "sessions",
        ),
        "sessions_first": sessions_first,
        "events_dedup": _with(f"SELECT {LOG_COLUMNS} FROM feed_once", "feed_once"),
        "quarantine": _with(QUARANTINE, "click_log"),
        "key_check": _with(
            " UNION ALL ".join(
                [
                    _key_check("customers", "SELECT customer_id FROM people", "customer_id"),
                    _key_check("products", "SELECT product_id FROM products", "product_id"),
                    _key_check("orders", "SELECT o_orderkey AS order_id FROM orders", "order_id"),
                    _key_check("sessions", "SELECT session_id FROM sessions", "session_id"),
                    _key_check("user_click_logs", "SELECT event_id FROM feed", "event_id"),
                    _key_check(
                        "user_recommendations",
                        "SELECT user_id, product_id FROM scores",
                        "user_id",
                        "product_id",
                    ),
                    _key_check(
                        "order_items",
                        "SELECT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem",
                        "order_id",
                        "product_id",
                    ),
                ]
            ),
            "feed",
            "people",
            "products",
            "sessions",
            "scores",
        ),
        "load_audit": _with(
            """SELECT 'customers' AS table_name, count(*) AS n_rows FROM customer
            UNION ALL SELECT 'products', count(*) FROM part
            UNION ALL SELECT 'orders', count(*) FROM orders
            UNION ALL SELECT 'order_items', count(*) FROM lineitem
            UNION ALL SELECT 'sessions', count(*) FROM sessions
            UNION ALL SELECT 'events', count(*) FROM events""",
            "sessions",
        ),
        "interactions_view": _with(
            """SELECT s.customer_id AS user_id, l.product_id,
                CAST(sum(l.batch) AS BIGINT) AS interaction_score
            FROM scored l LEFT JOIN sessions s ON l.session_id = s.session_id
            WHERE l.product_id IS NOT NULL AND s.customer_id IS NOT NULL
            GROUP BY s.customer_id, l.product_id""",
            "scored",
            "sessions",
        ),
        "order_interactions": """
            SELECT o_custkey AS user_id, l_partkey AS product_id,
                CAST(10 AS BIGINT) AS interaction_score
            FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
            WHERE l_partkey IS NOT NULL""",
        "user_product_interactions": _with("SELECT * FROM pairs", "pairs"),
        "product_popularity": _with("SELECT * FROM popularity", "popularity"),
        "top_products": _with(
            "SELECT * FROM popularity ORDER BY popularity_score DESC, product_id LIMIT 10",
            "popularity",
        ),
        "candidates_unseen": _with(
            """SELECT u.user_id, count(*) - count(h.product_id) AS n_candidates
            FROM (SELECT DISTINCT user_id FROM pairs) u CROSS JOIN popularity p
            LEFT JOIN pairs h ON h.user_id = u.user_id AND h.product_id = p.product_id
            GROUP BY u.user_id""",
            "popularity",
        ),
        "recommend_unseen": _with(
            """SELECT user_id, product_id, popularity_score, rank FROM (
                SELECT u.user_id, p.product_id, p.popularity_score,
                    CAST(row_number() OVER (PARTITION BY u.user_id
                        ORDER BY p.popularity_score DESC, p.product_id) AS INTEGER) AS rank
                FROM (SELECT DISTINCT user_id FROM pairs) u CROSS JOIN popularity p
                ANTI JOIN pairs h ON h.user_id = u.user_id AND h.product_id = p.product_id)
            WHERE rank <= 5""",
            "popularity",
        ),
        "als_input": _with(
            """SELECT CAST(user_id AS INTEGER) AS user_id, CAST(product_id AS INTEGER)
                AS product_id, CAST(interaction_score AS FLOAT) AS interaction_score
            FROM pairs""",
            "pairs",
        ),
        "user_scores": scores,
        "upsert_scores": scores,
        "recommend_top": _with(
            """SELECT s.product_id, p.name, p.category, s.score,
                CAST(row_number() OVER (ORDER BY s.score DESC, s.product_id) AS INTEGER) AS rank
            FROM (SELECT product_id, CAST(sum(popularity_score) AS BIGINT) AS score
                FROM scores GROUP BY product_id) s
            JOIN products p ON s.product_id = p.product_id
            ORDER BY rank LIMIT 200""",
            "scores",
            "products",
        ),
        "recommend_user": _with(
            "SELECT * FROM ranked_scores WHERE user_id = 10 ORDER BY rank LIMIT 20",
            "ranked_scores",
        ),
        "recommend_all": _with("SELECT * FROM ranked_scores WHERE rank <= 20", "ranked_scores"),
        "score_share": _with(
            """SELECT user_id, product_id, score, rank,
                (200 * score + best) // (2 * best) AS percent_of_best
            FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS best
                FROM ranked_scores WHERE rank <= 20)""",
            "ranked_scores",
        ),
        "product_search": _with(
            """SELECT product_id, name, category, CAST(price_usd AS DOUBLE) AS price,
                CAST(CASE WHEN name ILIKE '%ring%' THEN 3 WHEN category ILIKE '%ring%' THEN 2
                    ELSE 1 END AS DOUBLE) AS score
            FROM products
            WHERE (name ILIKE '%ring%' OR category ILIKE '%ring%')
                AND price_usd BETWEEN 900 AND 950
            ORDER BY score DESC, price_usd, product_id LIMIT 20""",
            "products",
        ),
        "recent_events": _with(
            """SELECT user_id, product_id, event_type,
                strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp
            FROM (SELECT * FROM feed ORDER BY timestamp DESC NULLS LAST, event_id DESC NULLS LAST
                LIMIT 30)""",
            "feed",
        ),
        "live_feed": _with(
            f"""SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, product_id, event_type, timestamp,
                {LABELS.format('%H:%M:%S')} AS time_label,
                {LABELS.format('%d %b %Y')} AS date_label,
                'user_' || user_id || ' → product_' || product_id AS event_label,
                '+' || live AS score_label
            FROM (SELECT * FROM feed_once
                ORDER BY timestamp DESC NULLS LAST, event_id DESC NULLS LAST LIMIT 100)""",
            "feed_once",
        ),
        "live_top_products": _with(
            """SELECT t.product_id, coalesce(p.name, 'product_' || t.product_id) AS name, t.score
            FROM (SELECT product_id, CAST(sum(live) AS BIGINT) AS score
                FROM (SELECT * FROM feed_once
                    ORDER BY timestamp DESC NULLS LAST, event_id DESC NULLS LAST LIMIT 200)
                GROUP BY product_id ORDER BY score DESC, product_id LIMIT 8) t
            LEFT JOIN products p ON t.product_id = p.product_id""",
            "feed_once",
            "products",
        ),
        "daily_kpis": _with(
            """SELECT count(*) AS total_events, count(DISTINCT user_id) AS active_users,
                count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
                CAST(coalesce((200 * sum(live) + count(*)) // (2 * count(*)), 0) AS DOUBLE) / 100
                    AS avg_score,
                CAST(max(event_date) AS VARCHAR) AS data_date
            FROM today""",
            "today",
        ),
        "active_countries": _with("SELECT * FROM active", "active"),
        "country_intensity": _with(
            """SELECT country, coalesce(display_name, country) AS display_name, active_users,
                active_users / (SELECT greatest(1, max(active_users)) FROM active) AS intensity
            FROM active LEFT JOIN (
                SELECT n_name, n_name || ', ' || r_name AS display_name
                FROM nation JOIN region ON n_regionkey = r_regionkey
                WHERE n_nationkey % 5 <> 0)
            ON country = n_name""",
            "active",
        ),
        "device_source": _with("SELECT * FROM traffic", "traffic"),
        "traffic_breakdown": _with(
            """SELECT 'device' AS kind, device AS name, CAST(sum(events) AS BIGINT) AS value
            FROM traffic GROUP BY device
            UNION ALL SELECT 'source', source, CAST(sum(events) AS BIGINT)
            FROM traffic GROUP BY source""",
            "traffic",
        ),
        "top_users": _with(
            """SELECT user_id, name, country, CAST(sum(live) AS BIGINT) AS total_score
            FROM scored JOIN people ON user_id = customer_id
            GROUP BY user_id, name, country ORDER BY total_score DESC, user_id LIMIT 3""",
            "scored",
            "people",
        ),
        "sales_filters": _with(
            """SELECT DISTINCT CAST(year(timestamp) AS INTEGER) AS year,
                CAST(month(timestamp) AS INTEGER) AS month, CAST(day(timestamp) AS INTEGER) AS day
            FROM sales""",
            "sales",
        ),
        "sales_filter_values": _with(
            """SELECT DISTINCT 'year' AS kind, CAST(year(timestamp) AS INTEGER) AS value FROM sales
            UNION ALL SELECT DISTINCT 'month', CAST(month(timestamp) AS INTEGER) FROM sales
            UNION ALL SELECT DISTINCT 'day', CAST(day(timestamp) AS INTEGER) FROM sales""",
            "sales",
        ),
        "sales_trend_hour": _with(
            _trend("hour", "CAST(timestamp AS DATE) = DATE '2024-01-30'"), "sales"
        ),
        "sales_trend_day": _with(DAY_TREND, "sales"),
        "sales_trend_month": _with(_trend("month", "year(timestamp) = 2024"), "sales"),
        "sales_trend_year": _with(_trend("year", "true"), "sales"),
        "sales_labels": _with(
            f"""SELECT period, order_count, revenue, strftime(period, '%-d %b') AS period_label,
                {_tick('amount', '>= 1000')} AS revenue_tick,
                {_money_label('amount')} AS revenue_label
            FROM (SELECT *, CAST(revenue AS DECIMAL(18,2)) AS amount FROM ({DAY_TREND}))""",
            "sales",
        ),
        "category_sales": _with(
            """SELECT category, total_sessions, total_events,
                CAST(revenue AS DOUBLE) AS total_revenue FROM categories""",
            "categories",
        ),
        "category_labels": _with(
            f"""SELECT category, total_sessions, total_events,
                CAST(revenue AS DOUBLE) AS total_revenue,
                {_tick('revenue', '> 1000')} AS revenue_tick,
                {_money_label('revenue')} AS revenue_label
            FROM categories""",
            "categories",
        ),
        "stream_user_scores": scores,
        "stream_score_increments": scores,
        "stream_click_log": _with(f"SELECT {LOG_COLUMNS} FROM delivered", "delivered"),
        "stream_sessions": sessions_first,
        "stream_dedup": _with(dedup.format("delivered"), "delivered"),
    }
