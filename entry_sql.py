"""SQL twins of the registered queries, for DuckDB over the same Parquet tables."""

from __future__ import annotations

# The nine marketplace tables from the star schema.
TABLES = """
m_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE WHEN o_orderstatus = 'O' THEN 'shipped' ELSE 'delivered' END AS order_status,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS order_purchase_timestamp,
    o_orderdate + to_hours(CAST(o_orderkey % 24 + 3 AS BIGINT)) AS order_approved_at,
    CASE WHEN o_orderkey % 103 <> 0 THEN o_orderdate
      + to_hours(CAST(o_orderkey % 24 + (o_orderkey * 37) % 480 AS BIGINT)) END
      AS order_delivered_carrier_date,
    CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 101 <> 0 THEN o_orderdate
      + to_hours(CAST(o_orderkey % 24 + (o_orderkey * 37) % 960 AS BIGINT)) END
      AS order_delivered_customer_date,
    o_orderdate + to_hours(CAST(24 * (12 + 4 * CAST(substr(o_orderpriority, 1, 1) AS INT))
      AS BIGINT)) AS order_estimated_delivery_date
  FROM orders),
m_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
    l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
    CASE WHEN l_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS price,
    l_extendedprice * abs(l_tax) AS freight_value
  FROM lineitem),
m_payments AS (
  SELECT CASE WHEN l_orderkey % 89 <> 0 THEN l_orderkey END AS order_id,
    CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL
      WHEN l_returnflag = 'A' THEN 'credit_card'
      WHEN l_returnflag = 'N' THEN 'boleto' ELSE 'voucher' END AS payment_type,
    CAST(l_quantity AS INT) % 12 + 1 AS payment_installments,
    l_extendedprice * (1 + abs(l_tax)) AS payment_value
  FROM lineitem),
m_reviews AS (
  SELECT CAST(floor(event_id / 2) AS BIGINT) AS order_id,
    CASE WHEN event_type <> 'error' THEN CAST(user_id % 5 + 1 AS INT) END AS review_score,
    ts AS review_creation_date, ts AS review_answer_timestamp
  FROM events),
m_products AS (
  SELECT p_partkey AS product_id,
    CASE WHEN p_type <> 'PROMO' THEN lower(p_type) END AS product_category_name,
    CAST(CASE WHEN p_size <> 50 THEN p_size * 100 END AS DOUBLE) AS product_weight_g,
    CAST(p_size AS DOUBLE) AS product_length_cm,
    CAST(p_size % 7 + 1 AS DOUBLE) AS product_height_cm,
    CAST(p_size % 11 + 1 AS DOUBLE) AS product_width_cm
  FROM part),
m_categories AS (
  SELECT DISTINCT
    CASE WHEN p_type NOT IN ('PROMO', 'STANDARD') THEN lower(p_type) END AS product_category_name,
    CASE WHEN p_type NOT IN ('PROMO', 'STANDARD') THEN concat(lower(p_type), '_en') END
      AS product_category_name_english
  FROM part),
m_customers AS (
  SELECT c_custkey AS customer_id,
    CAST(c_nationkey * 10 + c_custkey % 10 AS INT) AS customer_zip_code_prefix,
    n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
m_sellers AS (
  SELECT CASE WHEN s_suppkey % 17 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS seller_id,
    CAST(s_nationkey * 10 + s_suppkey % 10 AS INT) AS seller_zip_code_prefix,
    n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m_geolocation AS (
  SELECT CASE WHEN c_nationkey <> 24 THEN CAST(c_nationkey * 10 + c_custkey % 10 AS INT) END
      AS geolocation_zip_code_prefix,
    CAST(c_nationkey * 120 + (c_custkey * 7) % 13 - 3000 AS DOUBLE) / 100 AS geolocation_lat,
    CAST(c_nationkey * 130 + (c_custkey * 5) % 17 - 7000 AS DOUBLE) / 100 AS geolocation_lng
  FROM customer)"""

# Side tables at order, customer and seller grain.
ENRICHED = """
geo AS (
  SELECT geolocation_zip_code_prefix, median(geolocation_lat) AS geolocation_lat,
    median(geolocation_lng) AS geolocation_lng
  FROM m_geolocation WHERE geolocation_zip_code_prefix IS NOT NULL GROUP BY 1),
item_products AS (
  SELECT i.*, p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm,
    c.product_category_name_english AS category
  FROM m_items i
  LEFT JOIN m_products p ON i.product_id IS NOT DISTINCT FROM p.product_id
  LEFT JOIN m_categories c
    ON p.product_category_name IS NOT DISTINCT FROM c.product_category_name),
pay AS (
  SELECT order_id, coalesce(sum(payment_value), 0) AS payment_value,
    max(payment_installments) AS payment_installments,
    coalesce(string_agg(DISTINCT payment_type, ',' ORDER BY payment_type), '') AS payment_types
  FROM m_payments WHERE order_id IS NOT NULL GROUP BY 1),
category_mode AS (
  SELECT order_id, category FROM (
    SELECT order_id, category,
      row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, category) AS place
    FROM item_products WHERE category IS NOT NULL GROUP BY 1, 2) WHERE place = 1),
seller_mode AS (
  SELECT order_id, seller_id FROM (
    SELECT order_id, seller_id,
      row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, seller_id) AS place
    FROM item_products WHERE seller_id IS NOT NULL GROUP BY 1, 2) WHERE place = 1),
order_items AS (
  SELECT t.*, coalesce(c.category, 'unknown') AS category_most_common, s.seller_id
  FROM (
    SELECT order_id, count(order_item_id) AS total_items, coalesce(sum(price), 0) AS revenue,
      coalesce(sum(freight_value), 0) AS freight_value, avg(price) AS avg_item_price,
      avg(product_weight_g) AS avg_product_weight, avg(product_length_cm) AS avg_length_cm,
      avg(product_height_cm) AS avg_height_cm, avg(product_width_cm) AS avg_width_cm,
      CAST(count(DISTINCT category) AS INT) AS distinct_categories,
      CAST(count(DISTINCT seller_id) AS INT) AS seller_count
    FROM item_products WHERE order_id IS NOT NULL GROUP BY 1) t
  LEFT JOIN category_mode c USING (order_id) LEFT JOIN seller_mode s USING (order_id)),
customer_places AS (
  SELECT c.*, g.geolocation_zip_code_prefix, g.geolocation_lat AS customer_lat,
    g.geolocation_lng AS customer_lng
  FROM m_customers c LEFT JOIN geo g
    ON c.customer_zip_code_prefix = g.geolocation_zip_code_prefix),
seller_places AS (
  SELECT s.seller_id, s.seller_state, g.geolocation_lat AS seller_lat,
    g.geolocation_lng AS seller_lng
  FROM (SELECT *, row_number() OVER (PARTITION BY seller_id
      ORDER BY seller_state, seller_zip_code_prefix) AS place FROM m_sellers) s
  LEFT JOIN geo g ON s.seller_zip_code_prefix = g.geolocation_zip_code_prefix
  WHERE s.place = 1)"""


def _days(start: str, end: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS BIGINT)"


_DELAY = _days("order_estimated_delivery_date", "order_delivered_customer_date")

# Order dates with their derived columns.
DATED = f"""
dated AS (
  SELECT *, CAST(order_purchase_timestamp AS DATE) AS order_purchase_date,
    CAST(isodow(order_purchase_timestamp) - 1 AS INT) AS purchase_weekday,
    CAST(month(order_purchase_timestamp) AS INT) AS purchase_month,
    {_days("order_purchase_timestamp", "order_estimated_delivery_date")}
      AS estimated_delivery_days,
    {_days("order_purchase_timestamp", "order_delivered_customer_date")}
      AS actual_delivery_days,
    {_DELAY} AS delivery_delay, coalesce({_DELAY} > 0, FALSE) AS is_late
  FROM m_orders)"""

DISTANCE = """2 * 6371.0 * asin(least(1.0, sqrt(
      pow(sin((radians(coalesce(seller_lat, 0)) - radians(coalesce(customer_lat, 0))) / 2), 2)
      + cos(radians(coalesce(customer_lat, 0))) * cos(radians(coalesce(seller_lat, 0)))
      * pow(sin((radians(coalesce(seller_lng, 0)) - radians(coalesce(customer_lng, 0))) / 2), 2)
    )))"""

# The enriched order table, reviews fanned out by the join itself.
BASE = f"""
joined AS MATERIALIZED (
  SELECT o.*, c.* EXCLUDE (customer_id), p.payment_value,
    coalesce(p.payment_installments, 1) AS payment_installments, p.payment_types,
    r.review_score AS given_score, i.* EXCLUDE (order_id),
    s.seller_state, s.seller_lat, s.seller_lng,
    i.freight_value / nullif(i.revenue, 0) AS freight_ratio,
    split_part(p.payment_types, ',', 1) AS payment_type_primary
  FROM dated o
  LEFT JOIN customer_places c ON o.customer_id IS NOT DISTINCT FROM c.customer_id
  LEFT JOIN pay p ON o.order_id = p.order_id
  LEFT JOIN m_reviews r ON o.order_id IS NOT DISTINCT FROM r.order_id
  LEFT JOIN order_items i ON o.order_id = i.order_id
  LEFT JOIN seller_places s ON i.seller_id IS NOT DISTINCT FROM s.seller_id),
seller_past AS (
  SELECT seller_id, count(order_id) AS seller_orders,
    avg(CAST(is_late AS INT)) AS seller_late_rate
  FROM joined WHERE seller_id IS NOT NULL GROUP BY 1),
customer_past AS (
  SELECT customer_id, count(order_id) AS customer_orders,
    avg(CAST(is_late AS INT)) AS customer_late_rate
  FROM joined WHERE customer_id IS NOT NULL GROUP BY 1),
base AS MATERIALIZED (
  SELECT j.* EXCLUDE (given_score),
    coalesce(CAST(given_score AS DOUBLE), (SELECT median(given_score) FROM joined))
      AS review_score,
    {DISTANCE} AS distance_km,
    seller_orders, seller_late_rate, customer_orders, customer_late_rate
  FROM joined j LEFT JOIN seller_past USING (seller_id) LEFT JOIN customer_past USING (customer_id)),
delivered AS MATERIALIZED (SELECT * FROM base WHERE order_status = 'delivered')"""

CUBE = """
cube_rows AS MATERIALIZED (
  SELECT CAST(order_purchase_date AS VARCHAR) AS order_purchase_date, customer_state,
    category_most_common, purchase_month, coalesce(sum(revenue), 0) AS sum_revenue,
    CAST(count_if(is_late) AS BIGINT) AS sum_late,
    CAST(coalesce(sum(actual_delivery_days), 0) AS BIGINT) AS sum_delivery_days,
    coalesce(sum(review_score), 0) AS sum_review_score, count(order_id) AS order_count
  FROM delivered
  WHERE order_purchase_date IS NOT NULL AND customer_state IS NOT NULL
    AND category_most_common IS NOT NULL AND purchase_month IS NOT NULL
  GROUP BY ALL)"""

NUMERIC = [
    "estimated_delivery_days", "freight_value", "revenue", "avg_item_price", "total_items",
    "freight_ratio", "distance_km", "purchase_weekday", "purchase_month", "payment_installments",
    "seller_late_rate", "customer_late_rate", "distinct_categories",
]
CATEGORICAL = ["payment_type_primary", "customer_state", "seller_state"]

SPLIT = """
training AS (
  SELECT *, CAST(is_late AS INT) AS label,
    md5(concat_ws('#', CAST(order_id AS VARCHAR), CAST(review_score AS VARCHAR), '42')) AS hash
  FROM delivered),
label_sizes AS (SELECT label, count(*) AS n FROM training GROUP BY 1),
split AS MATERIALIZED (
  SELECT t.*, row_number() OVER (PARTITION BY t.label ORDER BY hash) <= round(s.n * 0.2) AS is_test
  FROM training t JOIN label_sizes s ON t.label = s.label)"""

LEVELS = {
    "tables": [TABLES],
    "enriched": [TABLES, ENRICHED],
    "dated": [TABLES, DATED],
    "base": [TABLES, ENRICHED, DATED, BASE],
    "cube": [TABLES, ENRICHED, DATED, BASE, CUBE],
    "split": [TABLES, ENRICHED, DATED, BASE, SPLIT],
}


def _sql(level: str, select: str) -> str:
    return "WITH " + ",".join(LEVELS[level]) + "\n" + select


def _revenue(key: str, select: str = "") -> str:
    return (
        f"SELECT {select or key}, round(coalesce(sum(revenue), 0), 2) AS revenue"
        f" FROM delivered WHERE {key} IS NOT NULL GROUP BY {key}"
    )


def _placed(ranking: str, key: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY revenue DESC, {key}) AS place FROM ({ranking})"


_KPIS = """SELECT round(coalesce(sum(revenue), 0), 2) AS total_revenue,
  round(avg(revenue), 4) AS avg_ticket, round(avg(actual_delivery_days), 6) AS avg_delivery_days,
  round(avg(CAST(is_late AS INT)), 6) AS late_rate,
  round(avg(review_score), 6) AS avg_review_score FROM delivered"""

_KPI_TEXTS = """concat('R$ ', format('{:,.2f}', coalesce(sum(revenue), 0))) AS total_revenue_text,
  concat('R$ ', format('{:,.2f}', avg(revenue))) AS avg_ticket_text,
  concat(format('{:.1f}', avg(actual_delivery_days)), ' dias') AS avg_delivery_days_text,
  concat(format('{:.2f}', avg(CAST(is_late AS INT)) * 100), '%') AS late_rate_text,
  format('{:.2f}', avg(review_score)) AS avg_review_score_text"""

_LEADERS = f""", by_category AS (
  SELECT category_most_common AS top_category, coalesce(sum(revenue), 0) AS r FROM delivered
  WHERE category_most_common IS NOT NULL GROUP BY 1 ORDER BY r DESC, 1 LIMIT 1),
by_state AS (
  SELECT customer_state AS top_state, coalesce(sum(revenue), 0) AS r FROM delivered
  WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY r DESC, 1 LIMIT 1),
by_delay AS (
  SELECT customer_state AS most_late_state, avg(CAST(is_late AS INT)) AS rate FROM delivered
  WHERE customer_state IS NOT NULL GROUP BY 1
  ORDER BY rate DESC, median(delivery_delay) DESC NULLS LAST, 1 LIMIT 1),
headline AS (SELECT {_KPI_TEXTS} FROM delivered)
SELECT headline.*, top_category,
  concat('R$ ', format('{{:,.2f}}', by_category.r)) AS top_category_revenue_text, top_state,
  concat('R$ ', format('{{:,.2f}}', by_state.r)) AS top_state_revenue_text, most_late_state,
  concat(format('{{:.2f}}', rate * 100), '%') AS most_late_state_late_rate_text
FROM headline, by_category, by_state, by_delay"""

_DELAYS = """SELECT customer_state, round(avg(CAST(is_late AS INT)), 6) AS late_rate,
  median(delivery_delay) AS median_delay, round(coalesce(sum(revenue), 0), 2) AS revenue
  FROM delivered WHERE customer_state IS NOT NULL GROUP BY 1"""

_CUBE_KPIS = """SELECT round(coalesce(sum(sum_revenue), 0), 2) AS total_revenue,
  round(sum(sum_revenue) / nullif(sum(order_count), 0), 4) AS avg_ticket,
  round(sum(sum_delivery_days) / nullif(sum(order_count), 0), 6) AS avg_delivery_days,
  round(sum(sum_late) / nullif(sum(order_count), 0), 6) AS late_rate,
  round(sum(sum_review_score) / nullif(sum(order_count), 0), 6) AS avg_review_score
  FROM cube_rows"""


def _item_columns() -> str:
    return """total_items, round(revenue, 6) AS revenue, round(freight_value, 6) AS freight_value,
  round(avg_item_price, 6) AS avg_item_price, round(avg_product_weight, 6) AS avg_product_weight,
  round(avg_length_cm, 6) AS avg_length_cm, round(avg_height_cm, 6) AS avg_height_cm,
  round(avg_width_cm, 6) AS avg_width_cm, distinct_categories, category_most_common"""


def _filter(state: str, category: str, date_from: str, date_to: str) -> str:
    return (
        f"customer_state = '{state}' AND category_most_common = '{category}'"
        f" AND order_purchase_date >= '{date_from}' AND order_purchase_date <= '{date_to}'"
    )


def _training_statistics() -> str:
    """Per numeric column of the training rows: median, then mean and deviation when filled."""
    parts = []
    for c in NUMERIC:
        filled = f"coalesce(CAST({c} AS DOUBLE), m)"
        parts.append(
            f"SELECT '{c}' AS feature, round(m, 6) AS median, round(avg({filled}), 6) AS mean,"
            f" round(CASE WHEN stddev_pop({filled}) = 0 THEN 1.0 ELSE stddev_pop({filled}) END, 6)"
            f" AS scale FROM split, (SELECT coalesce(median(CAST({c} AS DOUBLE)), 0.0) AS m"
            " FROM split WHERE NOT is_test) WHERE NOT is_test GROUP BY m"
        )
    return " UNION ALL ".join(parts)


def _category_slots() -> str:
    parts = [
        f"SELECT '{c}' AS feature, category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT)"
        f" AS slot FROM (SELECT DISTINCT coalesce({c}, 'missing') AS category FROM split"
        " WHERE NOT is_test)"
        for c in CATEGORICAL
    ]
    return " UNION ALL ".join(parts)


_RANKED_AUC = """SELECT round((sum(CASE WHEN label = 1 THEN mid END) - p * (p + 1) / 2.0)
  / (CAST(p AS DOUBLE) * n), 6) AS roc_auc,
  (SELECT count(*) FROM delivered WHERE seller_late_rate IS NULL) AS unscored
  FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0
      AS mid, count_if(label = 1) OVER () AS p, count_if(label = 0) OVER () AS n
    FROM (SELECT CAST(is_late AS INT) AS label, seller_late_rate AS score FROM delivered
      WHERE seller_late_rate IS NOT NULL)) GROUP BY p, n"""

_REPORT = """, guesses AS (
  SELECT CAST(is_late AS INT) AS label, CAST(seller_late_rate > 0.4 AS INT) AS guess
  FROM delivered WHERE seller_late_rate IS NOT NULL),
classes AS (
  SELECT c AS class, count_if(label = c) AS support, count_if(guess = c) AS guessed,
    count_if(label = c AND guess = c) AS hits
  FROM guesses, (VALUES (0), (1)) v(c) GROUP BY 1),
quality AS (
  SELECT CAST(class AS VARCHAR) AS class, coalesce(hits / nullif(guessed, 0), 0.0) AS precision,
    coalesce(hits / nullif(support, 0), 0.0) AS recall,
    coalesce(2 * hits / nullif(guessed + support, 0), 0.0) AS f1_score, support, hits
  FROM classes)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall,
  round(f1_score, 4) AS f1_score, CAST(support AS BIGINT) AS support FROM quality
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 4), round(sum(hits) / sum(support), 4),
  round(sum(hits) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM quality
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4),
  round(avg(f1_score), 4), CAST(sum(support) AS BIGINT) FROM quality
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
  round(sum(recall * support) / sum(support), 4),
  round(sum(f1_score * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM quality"""

_TIERS = """, history AS (SELECT avg(CAST(is_late AS INT)) AS baseline FROM delivered),
states AS (
  SELECT customer_state, avg(CAST(is_late AS INT)) AS rate FROM delivered
  WHERE customer_state IS NOT NULL GROUP BY 1)
SELECT customer_state, round(rate, 6) AS expected_late_rate,
  round(baseline, 6) AS baseline_late_rate,
  CASE WHEN rate > baseline * CAST(1.1 AS DOUBLE) THEN 'retrain'
    WHEN rate > baseline * CAST(1.05 AS DOUBLE) THEN 'watch' ELSE 'stable' END AS tier
FROM states, history"""

_CSV_COUNTS = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, count(*) AS n_rows, count({text}) AS n_texts,"
    f" round(coalesce(sum({number}), 0), 2) AS total, CAST({moment} AS VARCHAR) AS last_moment"
    f" FROM m_{table}"
    for table, text, number, moment in [
        ("customers", "customer_state", "customer_zip_code_prefix", "NULL"),
        ("geolocation", "geolocation_zip_code_prefix", "geolocation_lat", "NULL"),
        ("items", "product_id", "price", "max(shipping_limit_date)"),
        ("payments", "payment_type", "payment_value", "NULL"),
        ("reviews", "review_score", "review_score", "NULL"),
        ("orders", "order_status", "NULL", "max(order_delivered_customer_date)"),
        ("products", "product_category_name", "product_weight_g", "NULL"),
        ("sellers", "seller_state", "seller_zip_code_prefix", "NULL"),
        ("categories", "product_category_name_english", "NULL", "NULL"),
    ]
)

_BASE_COLUMNS = f"""order_id, customer_id, order_status,
  CAST(order_purchase_timestamp AS VARCHAR) AS order_purchase_timestamp,
  CAST(order_approved_at AS VARCHAR) AS order_approved_at,
  CAST(order_delivered_carrier_date AS VARCHAR) AS order_delivered_carrier_date,
  CAST(order_delivered_customer_date AS VARCHAR) AS order_delivered_customer_date,
  CAST(order_estimated_delivery_date AS VARCHAR) AS order_estimated_delivery_date,
  CAST(order_purchase_date AS VARCHAR) AS order_purchase_date, customer_zip_code_prefix,
  customer_state, geolocation_zip_code_prefix, round(customer_lat, 6) AS customer_lat,
  round(customer_lng, 6) AS customer_lng, round(payment_value, 6) AS payment_value,
  payment_installments, payment_types, review_score, {_item_columns()},
  seller_id, seller_count, seller_state, round(seller_lat, 6) AS seller_lat,
  round(seller_lng, 6) AS seller_lng, estimated_delivery_days, actual_delivery_days,
  delivery_delay, is_late, round(freight_ratio, 6) AS freight_ratio,
  round(distance_km, 6) AS distance_km, purchase_weekday, purchase_month, payment_type_primary,
  seller_orders, round(seller_late_rate, 6) AS seller_late_rate, customer_orders,
  round(customer_late_rate, 6) AS customer_late_rate"""


_MARTS = """, d AS (
  SELECT customer_state, avg(CAST(is_late AS INT)) AS late_rate, median(delivery_delay) AS median_delay,
    coalesce(sum(revenue), 0) AS revenue FROM delivered WHERE customer_state IS NOT NULL GROUP BY 1),
late AS (SELECT * FROM d ORDER BY late_rate DESC NULLS LAST, median_delay DESC NULLS LAST, customer_state LIMIT 12),
least AS (SELECT * FROM late ORDER BY late_rate DESC NULLS LAST, median_delay DESC NULLS LAST, customer_state LIMIT 10),
c AS (SELECT category_most_common AS k, coalesce(sum(revenue), 0) AS revenue FROM delivered
  WHERE category_most_common IS NOT NULL GROUP BY 1),
days AS (SELECT order_purchase_date AS k, coalesce(sum(revenue), 0) AS revenue FROM delivered
  WHERE order_purchase_date IS NOT NULL GROUP BY 1),
months AS (SELECT purchase_month AS k, avg(CAST(is_late AS INT)) AS late_rate FROM delivered
  WHERE purchase_month IS NOT NULL GROUP BY 1),
cells AS (SELECT count(order_id) AS n FROM delivered WHERE order_purchase_date IS NOT NULL
  AND customer_state IS NOT NULL AND category_most_common IS NOT NULL AND purchase_month IS NOT NULL
  GROUP BY order_purchase_date, customer_state, category_most_common, purchase_month),
edges AS (SELECT CAST(min(actual_delivery_days) AS DOUBLE) AS lo,
  CAST((max(actual_delivery_days) - min(actual_delivery_days)) / 30.0 AS DOUBLE) AS width FROM delivered),
bins AS (SELECT least(coalesce(floor((actual_delivery_days - lo) / nullif(width, 0)), 0), 29) AS bin, count(*) AS n
  FROM delivered, edges WHERE actual_delivery_days IS NOT NULL GROUP BY 1),
scores AS (SELECT floor(review_score) AS k, count(*) AS n FROM delivered WHERE review_score IS NOT NULL GROUP BY 1),
m(mart, n_rows, total) AS (
  SELECT 'kpi_summary', 1, coalesce(sum(revenue), 0) FROM delivered
  UNION ALL SELECT 'revenue_by_category', count(*), sum(revenue) FROM c
  UNION ALL SELECT 'revenue_by_state', count(*), sum(revenue) FROM d
  UNION ALL SELECT 'delay_by_state', count(*), sum(median_delay) FROM d
  UNION ALL SELECT 'top_states', count(*), sum(revenue) FROM (FROM d ORDER BY revenue DESC, customer_state LIMIT 12)
  UNION ALL SELECT 'top_categories', count(*), sum(revenue) FROM (FROM c ORDER BY revenue DESC, k LIMIT 12)
  UNION ALL SELECT 'late_states', count(*), sum(late_rate) FROM late
  UNION ALL SELECT 'delay_table', count(*), sum(late_rate) FROM least
  UNION ALL SELECT 'revenue_by_date', count(*), sum(revenue) FROM days
  UNION ALL SELECT 'month_profile', count(*), sum(late_rate) FROM months
  UNION ALL SELECT 'delivery_days_histogram', count(*), sum(n) FROM bins
  UNION ALL SELECT 'review_score_histogram', count(*), sum(n) FROM scores
  UNION ALL SELECT 'states', count(*), 0 FROM d
  UNION ALL SELECT 'categories', count(*), 0 FROM c
  UNION ALL SELECT 'date_bounds', 1, 0
  UNION ALL SELECT 'dashboard_cube', count(*), sum(n) FROM cells)
SELECT mart, CAST(n_rows AS BIGINT) AS n_rows, round(CAST(total AS DOUBLE), 2) AS total FROM m"""

_TIER_RULE = """, r AS (SELECT customer_state, avg(CAST(is_late AS INT)) AS rate FROM delivered
  WHERE customer_state IS NOT NULL GROUP BY 1),
f AS (SELECT CAST(unnest([0.9, 1.0, 1.04, 1.05, 1.06, 1.09, 1.1, 1.11]) AS DOUBLE) AS factor)
SELECT customer_state, factor,
  CASE WHEN rate * factor > rate * CAST(1.1 AS DOUBLE) THEN 'retrain'
    WHEN rate * factor > rate * CAST(1.05 AS DOUBLE) THEN 'watch' ELSE 'stable' END AS tier
FROM r, f"""


def _asof(key: str) -> str:
    """Totals of a key's strictly earlier purchases, per purchase moment."""
    return f"""SELECT {key}, order_purchase_timestamp,
    sum(o) OVER earlier - o AS orders, sum(l) OVER earlier - l AS late, sum(n) OVER earlier - n AS n
  FROM (SELECT {key}, order_purchase_timestamp, count(order_id) AS o, count_if(is_late) AS l, count(*) AS n
    FROM base WHERE {key} IS NOT NULL AND order_purchase_timestamp IS NOT NULL GROUP BY 1, 2)
  WINDOW earlier AS (PARTITION BY {key} ORDER BY order_purchase_timestamp)"""


_SELLER_ASOF = f""", a AS ({_asof('seller_id')})
SELECT seller_id, CAST(order_purchase_timestamp AS VARCHAR) AS order_purchase_timestamp,
  CAST(orders AS BIGINT) AS seller_orders, round(late / nullif(n, 0), 6) AS seller_late_rate FROM a"""

_BASE_ASOF = f""", a AS ({_asof('seller_id')}), c AS ({_asof('customer_id')})
SELECT order_id, review_score, CAST(a.orders AS BIGINT) AS seller_orders,
  round(a.late / nullif(a.n, 0), 6) AS seller_late_rate, CAST(c.orders AS BIGINT) AS customer_orders,
  round(c.late / nullif(c.n, 0), 6) AS customer_late_rate
FROM base LEFT JOIN a USING (seller_id, order_purchase_timestamp)
  LEFT JOIN c USING (customer_id, order_purchase_timestamp)"""


def _left_out(key: str) -> str:
    """Totals of a key's other rows that are not in the test part."""
    return f"""CASE WHEN {key}_id IS NOT NULL THEN CAST(coalesce(sum(CAST(counted AND order_id IS NOT NULL AS INT)) OVER {key}s, 0)
    - CAST(counted AND order_id IS NOT NULL AS INT) AS BIGINT) END AS {key}_orders,
  CASE WHEN {key}_id IS NOT NULL THEN round((sum(CAST(counted AND is_late AS INT)) OVER {key}s - CAST(counted AND is_late AS INT))
    / nullif(sum(CAST(counted AS INT)) OVER {key}s - CAST(counted AS INT), 0), 6) END AS {key}_late_rate"""


_TRAIN_ONLY = f""", r AS (
  SELECT order_id, review_score, seller_id, customer_id, is_late, NOT is_test AS counted FROM split
  UNION ALL SELECT order_id, review_score, seller_id, customer_id, is_late, true FROM base
    WHERE order_status IS DISTINCT FROM 'delivered')
SELECT order_id, review_score, {_left_out('seller')}, {_left_out('customer')} FROM r
WINDOW sellers AS (PARTITION BY seller_id), customers AS (PARTITION BY customer_id)"""


def oracle_queries(filters: dict[str, str]) -> dict[str, str]:
    chosen = "WHERE " + _filter(**filters)
    at_least = (
        "FROM cube_rows "
        f"WHERE order_purchase_date >= '{filters['date_from']}'"
        f" AND order_purchase_date <= '{filters['date_to']}'"
    )
    return {
        "geo_centroid": _sql(
            "enriched",
            "SELECT geolocation_zip_code_prefix, round(geolocation_lat, 6) AS geolocation_lat,"
            " round(geolocation_lng, 6) AS geolocation_lng FROM geo",
        ),
        "payments_per_order": _sql(
            "enriched",
            "SELECT order_id, round(payment_value, 6) AS payment_value, payment_installments,"
            " payment_types FROM pay",
        ),
        "items_per_order": _sql("enriched", f"SELECT order_id, {_item_columns()} FROM order_items"),
        "order_primary_seller": _sql(
            "enriched", "SELECT order_id, seller_id, seller_count FROM order_items"
        ),
        "customer_geo": _sql(
            "enriched",
            "SELECT * REPLACE (round(customer_lat, 6) AS customer_lat,"
            " round(customer_lng, 6) AS customer_lng) FROM customer_places",
        ),
        "seller_geo_dedup": _sql(
            "enriched",
            "SELECT * REPLACE (round(seller_lat, 6) AS seller_lat,"
            " round(seller_lng, 6) AS seller_lng) FROM seller_places",
        ),
        "order_delivery_features": _sql(
            "dated",
            "SELECT order_id, estimated_delivery_days, actual_delivery_days, delivery_delay,"
            " is_late FROM dated",
        ),
        "order_calendar": _sql(
            "dated",
            "SELECT order_id, CAST(order_purchase_date AS VARCHAR) AS order_purchase_date,"
            " purchase_weekday, purchase_month FROM dated",
        ),
        "order_distance": _sql(
            "base",
            "SELECT order_id, seller_id, round(distance_km, 6) AS distance_km FROM base",
        ),
        "order_freight_ratio": _sql(
            "enriched",
            "SELECT order_id, round(freight_value / nullif(revenue, 0), 6) AS freight_ratio"
            " FROM order_items",
        ),
        "order_payment_primary": _sql(
            "enriched",
            "SELECT order_id, split_part(payment_types, ',', 1) AS payment_type_primary FROM pay",
        ),
        "seller_history": _sql(
            "base",
            "SELECT seller_id, seller_orders, round(seller_late_rate, 6) AS seller_late_rate"
            " FROM seller_past",
        ),
        "customer_history": _sql(
            "base",
            "SELECT customer_id, customer_orders, round(customer_late_rate, 6)"
            " AS customer_late_rate FROM customer_past",
        ),
        "seller_history_asof": _sql("base", _SELLER_ASOF),
        "order_base_asof": _sql("base", _BASE_ASOF),
        "order_base_train_only": _sql("split", _TRAIN_ONLY),
        "review_fill": _sql("base", "SELECT median(given_score) AS fill_score FROM joined"),
        "order_base": _sql("base", f"SELECT {_BASE_COLUMNS} FROM base"),
        "kpi_summary": _sql("base", _KPIS),
        "kpi_formatted": _sql("base", f"SELECT {_KPI_TEXTS} FROM delivered"),
        "revenue_by_category": _sql(
            "base", _placed(_revenue("category_most_common"), "category_most_common")
        ),
        "revenue_by_state": _sql("base", _placed(_revenue("customer_state"), "customer_state")),
        "delay_by_state": _sql(
            "base",
            "SELECT *, row_number() OVER (ORDER BY late_rate DESC NULLS LAST,"
            f" median_delay DESC NULLS LAST, customer_state) AS place FROM ({_DELAYS})",
        ),
        "top_category": _sql(
            "base",
            _revenue("category_most_common") + " ORDER BY revenue DESC, category_most_common LIMIT 1",
        ),
        "top_state": _sql(
            "base", _revenue("customer_state") + " ORDER BY revenue DESC, customer_state LIMIT 1"
        ),
        "delay_state_top10": _sql(
            "base",
            _DELAYS + " ORDER BY avg(CAST(is_late AS INT)) DESC, median_delay DESC NULLS LAST,"
            " customer_state LIMIT 10",
        ),
        "state_top12": _sql(
            "base", _revenue("customer_state") + " ORDER BY revenue DESC, customer_state LIMIT 12"
        ),
        "category_top12": _sql(
            "base",
            _revenue("category_most_common")
            + " ORDER BY revenue DESC, category_most_common LIMIT 12",
        ),
        "late_state_top12": _sql(
            "base",
            _DELAYS + " ORDER BY avg(CAST(is_late AS INT)) DESC, median_delay DESC NULLS LAST,"
            " customer_state LIMIT 12",
        ),
        "delay_table_formatted": _sql(
            "base",
            "SELECT customer_state, format('{:,.2f}', coalesce(sum(revenue), 0)) AS revenue_text,"
            " concat(format('{:.2f}', avg(CAST(is_late AS INT)) * 100), '%') AS late_rate_text,"
            " format('{:.1f}', median(delivery_delay)) AS median_delay_text FROM delivered"
            " WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY avg(CAST(is_late AS INT)) DESC,"
            " median(delivery_delay) DESC NULLS LAST, customer_state LIMIT 10",
        ),
        "revenue_by_date": _sql(
            "base",
            _revenue(
                "order_purchase_date",
                "CAST(order_purchase_date AS VARCHAR) AS order_purchase_date",
            ),
        ),
        "profile_by_month": _sql(
            "base",
            "SELECT purchase_month, round(avg(CAST(is_late AS INT)), 6) AS late_rate,"
            " round(coalesce(sum(revenue), 0), 2) AS revenue FROM delivered"
            " WHERE purchase_month IS NOT NULL GROUP BY 1",
        ),
        "delivery_days_hist": _sql(
            "base",
            ", edges AS (SELECT CAST(min(actual_delivery_days) AS DOUBLE) AS lo,"
            " (max(actual_delivery_days) - min(actual_delivery_days)) / 30.0 AS width"
            " FROM delivered),"
            " binned AS (SELECT CAST(least(coalesce(floor((actual_delivery_days - lo)"
            " / nullif(CAST(width AS DOUBLE), 0)), 0), 29) AS INT) AS bin, lo,"
            " CAST(width AS DOUBLE) AS width"
            " FROM delivered, edges WHERE actual_delivery_days IS NOT NULL)"
            " SELECT bin, round(lo + bin * width, 6) AS bin_start,"
            " round(lo + (bin + 1) * width, 6) AS bin_end, count(*) AS n"
            " FROM binned GROUP BY bin, lo, width",
        ),
        "review_score_hist": _sql(
            "base",
            "SELECT CAST(floor(review_score) AS INT) AS score, count(*) AS n FROM delivered"
            " WHERE review_score IS NOT NULL GROUP BY 1",
        ),
        "filter_domains": _sql(
            "base",
            "SELECT 'state' AS domain, customer_state AS value FROM delivered"
            " WHERE customer_state IS NOT NULL"
            " UNION SELECT 'category', category_most_common FROM delivered"
            " WHERE category_most_common IS NOT NULL",
        ),
        "date_bounds": _sql(
            "base",
            "SELECT CAST(min(order_purchase_date) AS VARCHAR) AS min_date,"
            " CAST(max(order_purchase_date) AS VARCHAR) AS max_date FROM delivered",
        ),
        "dashboard_cube": _sql(
            "cube",
            "SELECT * REPLACE (round(sum_revenue, 2) AS sum_revenue) FROM cube_rows",
        ),
        "cube_json": _sql(
            "cube",
            "SELECT * REPLACE (round(sum_revenue, 2) AS sum_revenue) FROM cube_rows",
        ),
        "cube_rollup": _sql(
            "cube",
            "SELECT customer_state, purchase_month, round(sum(sum_revenue), 2) AS sum_revenue,"
            " CAST(sum(sum_late) AS BIGINT) AS sum_late,"
            " CAST(sum(sum_delivery_days) AS BIGINT) AS sum_delivery_days,"
            " sum(sum_review_score) AS sum_review_score,"
            " CAST(sum(order_count) AS BIGINT) AS order_count FROM cube_rows GROUP BY 1, 2",
        ),
        "page_kpis": _sql("cube", _CUBE_KPIS),
        "filtered_kpis": _sql("cube", f"{_CUBE_KPIS} {chosen}"),
        "filtered_revenue_by_date": _sql(
            "cube",
            "SELECT order_purchase_date, round(sum(sum_revenue), 2) AS sum_revenue"
            f" FROM cube_rows {chosen} GROUP BY 1",
        ),
        "filtered_state_top12": _sql(
            "cube",
            f"SELECT customer_state, round(sum(sum_revenue), 2) AS sum_revenue {at_least}"
            " GROUP BY 1 ORDER BY sum(sum_revenue) DESC, customer_state LIMIT 12",
        ),
        "filtered_category_top12": _sql(
            "cube",
            f"SELECT category_most_common, round(sum(sum_revenue), 2) AS sum_revenue {at_least}"
            " GROUP BY 1 ORDER BY sum(sum_revenue) DESC, category_most_common LIMIT 12",
        ),
        "filtered_late_state_top12": _sql(
            "cube",
            "SELECT customer_state, CAST(sum(sum_late) AS BIGINT) AS sum_late,"
            " CAST(sum(order_count) AS BIGINT) AS order_count,"
            f" round(sum(sum_late) / sum(order_count), 6) AS late_rate {at_least}"
            " GROUP BY 1 ORDER BY sum(sum_late) / sum(order_count) DESC, customer_state LIMIT 12",
        ),
        "filtered_late_month": _sql(
            "cube",
            "SELECT purchase_month, CAST(sum(sum_late) AS BIGINT) AS sum_late,"
            " CAST(sum(order_count) AS BIGINT) AS order_count,"
            f" round(sum(sum_late) / sum(order_count), 6) AS late_rate FROM cube_rows {chosen}"
            " GROUP BY 1",
        ),
        "training_rows": _sql(
            "base",
            "SELECT order_id, review_score, CAST(is_late AS DOUBLE) AS label, "
            + ", ".join(
                f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in NUMERIC
            )
            + f", {', '.join(CATEGORICAL)} FROM delivered",
        ),
        "stratified_split_counts": _sql(
            "split",
            "SELECT label, is_test, count(*) AS n, CAST(sum(order_id) AS BIGINT) AS id_total"
            " FROM split GROUP BY ALL",
        ),
        "approximate_split_counts": _sql(
            "split",
            "SELECT label, CAST(concat('0x', substr(hash, 1, 13)) AS BIGINT)"
            " < CAST(floor(0.2 * 4503599627370496) AS BIGINT) AS is_test,"
            " count(*) AS n, CAST(sum(order_id) AS BIGINT) AS id_total FROM split GROUP BY ALL",
        ),
        "holdout_sample": _sql(
            "split",
            "SELECT order_id, review_score, is_late FROM training ORDER BY hash LIMIT 80",
        ),
        "impute_scale_numeric": _sql("split", _training_statistics()),
        "onehot_categorical": _sql("split", _category_slots()),
        "auc_of_score": _sql("base", _RANKED_AUC),
        "classification_report_of_score": _sql("base", _REPORT),
        "drift_tier_by_state": _sql("base", _TIERS),
        "historical_late_rate": _sql(
            "base",
            "SELECT round(avg(CAST(is_late AS INT)), 6) AS baseline_late_rate FROM delivered",
        ),
        "report_headline": _sql("base", _LEADERS),
        "csv_roundtrip": _sql("tables", _CSV_COUNTS),
        "csv_quoted_lines": _sql(
            "tables",
            "SELECT product_id, product_category_name || chr(10) || '\"q\", '"
            " || CAST(product_id AS VARCHAR) AS product_category_name, product_weight_g,"
            " product_width_cm FROM m_products",
        ),
        "marts_roundtrip": _sql("base", _MARTS),
        "missing_inputs": "SELECT * FROM (VALUES ('sellers', NULL), ('items', 'price'), ('orders', 'order_status'))"
        " AS t(table_name, column_name)",
        "drift_tier_rule": _sql("base", _TIER_RULE),
        "late_model_rows": _sql(
            "split",
            "SELECT order_id, review_score, label, true AS score_in_range,"
            " true AS prediction_follows FROM split WHERE is_test",
        ),
        "late_model_quality": _sql(
            "split",
            """, tested AS (SELECT label, count(*) AS n FROM split WHERE is_test GROUP BY 1)
SELECT CAST(label AS VARCHAR) AS class, n AS support, true AS in_range, true AS useful FROM tested
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), CAST(sum(n) AS BIGINT),
  true, true FROM tested""",
        ),
        "drift_check_rule": _sql(
            "base",
            "SELECT CAST(80 AS BIGINT) AS orders, round(avg(CAST(is_late AS INT)), 6)"
            " AS baseline_late_rate, true AS rate_in_range, true AS tier_follows FROM delivered",
        ),
        "report_texts": _sql(
            "base",
            "SELECT total_revenue_text, avg_ticket_text, top_category, top_state, most_late_state"
            f" FROM (WITH nothing AS (SELECT 1){_LEADERS})",
        ),
    }
