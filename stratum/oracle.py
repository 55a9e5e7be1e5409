"""Independent SQL statements of every registered query (DuckDB dialect).

The fixture rules of :mod:`stratum.fixtures` and the models are restated
here as plain SQL over the raw test tables, written from the model
definitions rather than generated from the Spark code, so the two sides can
disagree when either is wrong.
"""

from __future__ import annotations

ORDER_TIEBREAK_SQL = ("updated_at DESC, product_id DESC, supp_key DESC, amount DESC, "
                      "quantity DESC, discount DESC, tax DESC, _is_deleted DESC")

FIXTURES = f"""
bronze_orders AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_key,
         l_linenumber AS line_number, o_custkey AS user_id, l_partkey AS product_id,
         l_suppkey AS supp_key,
         CASE o_orderstatus WHEN 'F' THEN ' Completed' WHEN 'O' THEN 'PENDING '
                            WHEN 'P' THEN 'weird' END AS status,
         l_extendedprice AS amount, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
         CAST(o_orderdate AS DATE) AS order_date, l_shipdate AS updated_at,
         l_shipdate + to_seconds(l_suppkey % 90) AS _synced_at,
         CAST(l_returnflag = 'R' AS INTEGER) AS _is_deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
latest_orders AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY {ORDER_TIEBREAK_SQL}) AS rn
    FROM bronze_orders) WHERE rn = 1),
stg_orders AS (
  SELECT id AS order_id, user_id, product_id,
         CASE WHEN lower(trim(status)) IN ('completed', 'cancelled', 'pending', 'refunded')
              THEN lower(trim(status)) ELSE 'unknown' END AS order_status,
         CAST(amount AS DECIMAL(18,2)) AS amount_usd,
         order_date,
         CAST(date_trunc('month', order_date) AS DATE) AS order_month,
         CAST(year(order_date) AS INTEGER) AS order_year,
         CAST(date_trunc('week', order_date) AS DATE) AS order_week_start,
         updated_at AS source_updated_at, _synced_at AS replicated_at
  FROM latest_orders
  WHERE _is_deleted = 0 AND amount > 0 AND order_date IS NOT NULL),
bronze_products AS (
  SELECT p_partkey AS id, p_name AS name, ' ' || p_type AS category, p_retailprice AS price,
         TIMESTAMP '1995-01-01 00:00:00' AS updated_at,
         TIMESTAMP '1995-01-01 00:00:00' AS _synced_at, 0 AS _is_deleted
  FROM part),
stg_products AS (
  SELECT id AS product_id, trim(name) AS product_name, trim(category) AS category,
         CAST(price AS DECIMAL(18,2)) AS price_usd,
         updated_at AS source_updated_at, _synced_at AS replicated_at
  FROM bronze_products WHERE _is_deleted = 0),
first_order AS (
  SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey),
bronze_users AS (
  SELECT c_custkey AS id, c_name AS name, '  ' || upper(c_name) || '@Example.com ' AS email,
         n_name AS country, created_at,
         coalesce(created_at, TIMESTAMP '1995-01-01 00:00:00') AS updated_at,
         coalesce(created_at, TIMESTAMP '1995-01-01 00:00:00') AS _synced_at,
         0 AS _is_deleted
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN first_order ON c_custkey = o_custkey),
stg_users AS (
  SELECT id AS user_id, trim(name) AS user_name, lower(trim(email)) AS email,
         trim(country) AS country,
         CAST(created_at AS DATE) AS signup_date,
         CAST(date_trunc('month', CAST(created_at AS DATE)) AS DATE) AS signup_month,
         CAST(year(created_at) AS INTEGER) AS signup_year,
         updated_at AS source_updated_at, _synced_at AS replicated_at
  FROM bronze_users WHERE _is_deleted = 0 AND email <> ''),
fct_sales AS (
  SELECT o.order_id, o.user_id, o.product_id, p.product_name, p.category,
         p.price_usd AS unit_price_usd, u.user_name, u.email, u.country, u.signup_date,
         o.order_status, o.amount_usd, o.amount_usd - p.price_usd AS gross_margin_usd,
         o.order_date, o.order_month, o.order_year, o.order_week_start,
         CAST(isodow(o.order_date) AS INTEGER) AS day_of_week,
         CAST(dayofmonth(o.order_date) AS INTEGER) AS day_of_month,
         CASE WHEN o.order_status = 'completed' THEN 1 ELSE 0 END AS is_completed,
         CASE WHEN o.order_status = 'cancelled' THEN 1 ELSE 0 END AS is_cancelled,
         o.replicated_at AS data_replicated_at
  FROM stg_orders o
  LEFT JOIN stg_products p ON o.product_id = p.product_id
  LEFT JOIN stg_users u ON o.user_id = u.user_id
  WHERE o.order_status <> 'unknown'),
rls_policy AS (
  SELECT r_name AS principal, n_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def with_fixtures(body: str) -> str:
    return "WITH " + FIXTURES.strip() + "\n" + body


FCT_DOUBLE = """
  SELECT order_id, user_id, product_id, product_name, category,
         CAST(unit_price_usd AS DOUBLE) AS unit_price_usd, user_name, email, country,
         signup_date, order_status, CAST(amount_usd AS DOUBLE) AS amount_usd,
         CAST(gross_margin_usd AS DOUBLE) AS gross_margin_usd, order_date, order_month,
         order_year, order_week_start, day_of_week, day_of_month, is_completed, is_cancelled,
         data_replicated_at
"""

ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------ step 1
ORACLE["latest_by_key"] = with_fixtures("SELECT * FROM latest_orders")

ORACLE["latest_composite_key"] = with_fixtures(f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id, order_date ORDER BY {ORDER_TIEBREAK_SQL}) AS rn
  FROM bronze_orders) WHERE rn = 1""")

ORACLE["stg_orders"] = with_fixtures("""
SELECT order_id, user_id, product_id, order_status, CAST(amount_usd AS DOUBLE) AS amount_usd,
       order_date, order_month, order_year, order_week_start, source_updated_at, replicated_at
FROM stg_orders""")

ORACLE["stg_products"] = with_fixtures("""
SELECT product_id, product_name, category, CAST(price_usd AS DOUBLE) AS price_usd,
       source_updated_at, replicated_at FROM stg_products""")

ORACLE["stg_users"] = with_fixtures("SELECT * FROM stg_users")

ORACLE["fct_sales"] = with_fixtures(FCT_DOUBLE + " FROM fct_sales")

ORACLE["dim_products"] = with_fixtures("""
SELECT id AS product_id, trim(name) AS name, trim(category) AS category,
       CAST(CAST(price AS DECIMAL(10,2)) AS DOUBLE) AS price, updated_at
FROM bronze_products WHERE _is_deleted = 0""")

ORACLE["join_default_fill"] = with_fixtures("""
SELECT o.order_id, o.user_id, o.product_id,
       coalesce(p.product_name, '') AS product_name, coalesce(p.category, '') AS category,
       CAST(coalesce(p.price_usd, 0) AS DOUBLE) AS unit_price_usd,
       coalesce(u.user_name, '') AS user_name, coalesce(u.email, '') AS email,
       coalesce(u.country, '') AS country, coalesce(u.signup_date, DATE '1970-01-01') AS signup_date,
       o.order_status, CAST(o.amount_usd AS DOUBLE) AS amount_usd,
       CAST(o.amount_usd - coalesce(p.price_usd, 0) AS DOUBLE) AS gross_margin_usd,
       o.order_date, o.order_month, o.order_year, o.order_week_start,
       CAST(isodow(o.order_date) AS INTEGER) AS day_of_week,
       CAST(dayofmonth(o.order_date) AS INTEGER) AS day_of_month,
       CASE WHEN o.order_status = 'completed' THEN 1 ELSE 0 END AS is_completed,
       CASE WHEN o.order_status = 'cancelled' THEN 1 ELSE 0 END AS is_cancelled,
       o.replicated_at AS data_replicated_at
FROM stg_orders o
LEFT JOIN (SELECT * FROM stg_products WHERE product_id % 10 <> 0) p ON o.product_id = p.product_id
LEFT JOIN stg_users u ON o.user_id = u.user_id
WHERE o.order_status <> 'unknown'""")

# ------------------------------------------------------------------ step 2
ORACLE["orders_by_status"] = with_fixtures("""
SELECT order_status AS status, count(*) AS count,
       CAST(sum(amount_usd) AS DOUBLE) AS totalAmount
FROM fct_sales GROUP BY order_status""")

ORACLE["sales_by_category_month"] = with_fixtures("""
SELECT category, CAST(date_trunc('month', order_date) AS DATE) AS orderDate_month,
       count(*) AS count, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount,
       CAST(sum(amount_usd) AS DOUBLE) / count(amount_usd) AS avgOrderValue,
       CAST(sum(gross_margin_usd) AS DOUBLE) AS grossMargin
FROM fct_sales GROUP BY 1, 2""")

ORACLE["sales_by_country_week"] = with_fixtures("""
SELECT country, CAST(date_trunc('week', order_date) AS DATE) AS orderDate_week,
       count(*) AS count, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount
FROM fct_sales GROUP BY 1, 2""")

ORACLE["avg_price_by_category"] = with_fixtures("""
SELECT category, count(*) AS count,
       CAST(sum(price_usd) AS DOUBLE) / count(price_usd) AS avgPrice
FROM stg_products GROUP BY category""")

ORACLE["margin_ratio_having"] = with_fixtures("""
SELECT * FROM (
  SELECT category, order_status AS status, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount,
         CAST(sum(gross_margin_usd) AS DOUBLE) / NULLIF(CAST(sum(amount_usd) AS DOUBLE), 0)
           AS marginRatio
  FROM fct_sales GROUP BY 1, 2) WHERE marginRatio > 0.982""")

ORACLE["top_product"] = with_fixtures("""
SELECT product_id AS productId, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount
FROM fct_sales GROUP BY 1 ORDER BY 2 DESC, 1 ASC LIMIT 1""")

ORACLE["drill_orders"] = with_fixtures("""
SELECT order_id AS id FROM fct_sales
WHERE order_status = 'completed' AND country = 'NATION_7' ORDER BY order_id LIMIT 100""")

ORACLE["rls_orders"] = with_fixtures("""
SELECT country, count(*) AS count, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount
FROM fct_sales
WHERE country IN (SELECT country FROM rls_policy WHERE principal = 'EUROPE')
GROUP BY country""")

ORACLE["param_sql"] = with_fixtures("""
SELECT order_status AS status, count(*) AS n, CAST(sum(amount_usd) AS DOUBLE) AS total
FROM fct_sales WHERE country = 'NATION_3' AND order_date >= DATE '1998-01-01'
GROUP BY order_status""")

# ------------------------------------------------------------------ step 3
ORACLE["rollup_day_category"] = with_fixtures("""
SELECT category, order_status AS status, order_date AS orderDate_day,
       count(*) AS count__n, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount__s,
       CAST(sum(amount_usd) AS DOUBLE) AS avgOrderValue__s, count(amount_usd) AS avgOrderValue__c,
       CAST(sum(gross_margin_usd) AS DOUBLE) AS grossMargin__s,
       CAST(sum(gross_margin_usd) AS DOUBLE) AS marginRatio__num,
       CAST(sum(amount_usd) AS DOUBLE) AS marginRatio__den
FROM fct_sales GROUP BY 1, 2, 3""")

ORACLE["rollup_answer_month"] = with_fixtures("""
SELECT category, CAST(date_trunc('month', order_date) AS DATE) AS orderDate_month,
       count(*) AS count, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount,
       CAST(sum(amount_usd) AS DOUBLE) / count(amount_usd) AS avgOrderValue,
       CAST(sum(gross_margin_usd) AS DOUBLE) / NULLIF(CAST(sum(amount_usd) AS DOUBLE), 0)
         AS marginRatio
FROM fct_sales GROUP BY 1, 2""")

ORACLE["rollup_choice"] = with_fixtures("""
, k AS (SELECT category, order_status AS status, order_date AS day, CAST(date_trunc('month', order_date) AS DATE) AS month FROM fct_sales),
t AS (SELECT 1 AS pos, 'wide' AS rollup, (SELECT count(*) FROM (SELECT DISTINCT category, status, day FROM k)) AS rollup_rows
      UNION ALL SELECT 2, 'narrow', (SELECT count(*) FROM (SELECT DISTINCT category, month FROM k))
      UNION ALL SELECT 3, 'states', (SELECT count(*) FROM (SELECT DISTINCT status, day FROM k))),
a(question, rollup) AS (VALUES ('by category and month', 'wide'), ('by category and month', 'narrow'),
      ('by category', 'wide'), ('by category', 'narrow'), ('by status and day', 'wide'),
      ('by status and day', 'states'), ('by country and year', NULL))
SELECT question, arg_min(t.rollup, (rollup_rows, pos)) AS rollup, min(rollup_rows) AS rollup_rows
FROM a LEFT JOIN t USING (rollup) GROUP BY question""")

# ------------------------------------------------------------------ step 4
ORACLE["check_not_null"] = with_fixtures("""
SELECT 'orders' AS "table", 'not_null' AS "check", 'id' AS "column",
       count(*) FILTER (WHERE id IS NULL) AS failures FROM bronze_orders
UNION ALL SELECT 'orders', 'not_null', 'amount', count(*) FILTER (WHERE amount IS NULL) FROM bronze_orders
UNION ALL SELECT 'products', 'not_null', 'id', count(*) FILTER (WHERE id IS NULL) FROM bronze_products
UNION ALL SELECT 'products', 'not_null', 'price', count(*) FILTER (WHERE price IS NULL) FROM bronze_products
UNION ALL SELECT 'users', 'not_null', 'id', count(*) FILTER (WHERE id IS NULL) FROM bronze_users
UNION ALL SELECT 'users', 'not_null', 'email', count(*) FILTER (WHERE email IS NULL) FROM bronze_users""")

ORACLE["check_unique"] = with_fixtures("""
SELECT 'bronze_orders' AS "table", 'unique' AS "check", 'id' AS "column",
       (SELECT count(*) FROM (SELECT id FROM bronze_orders WHERE id IS NOT NULL
                              GROUP BY id HAVING count(*) > 1)) AS failures
UNION ALL SELECT 'stg_orders', 'unique', 'order_id',
       (SELECT count(*) FROM (SELECT order_id FROM stg_orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'stg_products', 'unique', 'product_id',
       (SELECT count(*) FROM (SELECT product_id FROM stg_products GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'stg_users', 'unique', 'user_id',
       (SELECT count(*) FROM (SELECT user_id FROM stg_users GROUP BY 1 HAVING count(*) > 1))""")

ORACLE["check_references"] = with_fixtures("""
SELECT order_id, product_id FROM stg_orders
WHERE product_id IS NOT NULL AND product_id % 10 = 0""")

ORACLE["check_accepted"] = with_fixtures("""
SELECT 'stg_orders' AS "table", 'accepted_values' AS "check", 'order_status' AS "column",
       count(*) FILTER (WHERE order_status NOT IN ('completed','cancelled','pending','refunded'))
         AS failures
FROM stg_orders""")

ORACLE["check_range"] = with_fixtures("""
SELECT 'stg_orders' AS "table", 'in_range' AS "check", 'order_date' AS "column",
       count(*) FILTER (WHERE order_date < DATE '1995-01-01' OR order_date > DATE '2000-12-31')
         AS failures
FROM stg_orders""")

ORACLE["quality_report"] = with_fixtures("""
SELECT 'stg_orders' AS "table", 'not_null' AS "check", 'order_id' AS "column",
       count(*) FILTER (WHERE order_id IS NULL) AS failures FROM stg_orders
UNION ALL SELECT 'stg_orders', 'not_null', 'amount_usd', count(*) FILTER (WHERE amount_usd IS NULL) FROM stg_orders
UNION ALL SELECT 'stg_orders', 'unique', 'order_id',
       (SELECT count(*) FROM (SELECT order_id FROM stg_orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'stg_orders', 'accepted_values', 'order_status',
       count(*) FILTER (WHERE order_status NOT IN ('completed','cancelled','pending','refunded'))
       FROM stg_orders
UNION ALL SELECT 'stg_orders', 'in_range', 'order_date',
       count(*) FILTER (WHERE order_date < DATE '1995-01-01' OR order_date > DATE '2000-12-31')
       FROM stg_orders
UNION ALL SELECT 'stg_orders', 'relationships', 'product_id',
       count(*) FILTER (WHERE product_id % 10 = 0) FROM stg_orders
UNION ALL SELECT 'stg_users', 'not_null', 'email', count(*) FILTER (WHERE email IS NULL) FROM stg_users""")

# ------------------------------------------------------------------ step 5
CHANGES = f"""
, seq_orders AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at, product_id, supp_key, amount,
                                 quantity, discount, tax, _is_deleted) AS seq
  FROM bronze_orders),
changes AS (
  SELECT id, user_id, product_id, supp_key, status,
         CAST(CAST(amount AS DECIMAL(10,2)) AS DOUBLE) AS amount, quantity, discount, tax,
         order_date, updated_at,
         CASE WHEN _is_deleted = 1 THEN 'd' WHEN seq = 1 THEN 'c' ELSE 'u' END AS op,
         epoch_ms(updated_at) AS ts_ms, seq AS _offset, _is_deleted, _synced_at
  FROM seq_orders)
"""


def with_changes(body: str) -> str:
    return "WITH " + FIXTURES.strip() + CHANGES + body


ORACLE["cdc_unwrap"] = with_changes("SELECT * FROM changes")

ORACLE["cdc_quarantine"] = with_changes("""
SELECT 'shop.public.orders' AS topic, '-1' AS key, '{oops' AS value""")

ORACLE["cdc_soft_delete_latest"] = with_changes("""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, _offset DESC) AS rn
  FROM changes) WHERE rn = 1 AND _is_deleted = 0""")

ORACLE["cdc_drop_deletes"] = with_changes("SELECT * FROM changes WHERE op <> 'd'")

ORACLE["decode_envelope_values"] = with_changes(
    "SELECT id, _offset, amount, order_date, updated_at, ts_ms FROM changes")

ORACLE["cdc_variant_rows"] = with_changes("""
SELECT id, user_id, product_id, status,
       CASE WHEN id % 11 <> 0 AND id % 13 <> 0 THEN quantity END AS quantity, discount, tax, op, _offset,
       CASE WHEN id % 7 = 0 THEN '{"channel":"web"}' END AS rest,
       concat_ws(',', CASE WHEN id % 17 = 0 AND user_id IS NOT NULL THEN 'user_id' END,
                 CASE WHEN id % 13 = 0 AND id % 11 <> 0 AND quantity IS NOT NULL THEN 'quantity' END) AS retyped
FROM changes""")

ORACLE["cdc_drift_report"] = with_changes("""
, drift AS (
  SELECT 'channel' AS field, 'added' AS status, 'STRING' AS found, id FROM changes WHERE id % 7 = 0
  UNION ALL SELECT 'quantity', 'missing', 'VOID', id FROM changes WHERE id % 11 = 0 OR quantity IS NULL
  UNION ALL SELECT 'quantity', 'retyped', 'STRING', id FROM changes
            WHERE id % 13 = 0 AND id % 11 <> 0 AND quantity IS NOT NULL
  UNION ALL SELECT 'user_id', 'retyped', 'STRING', id FROM changes WHERE id % 17 = 0 AND user_id IS NOT NULL
  UNION ALL SELECT 'user_id', 'missing', 'VOID', id FROM changes WHERE user_id IS NULL
  UNION ALL SELECT 'status', 'missing', 'VOID', id FROM changes WHERE status IS NULL)
SELECT field, status, found, count(*) AS records FROM drift GROUP BY ALL""")

ORACLE["stream_latest"] = ORACLE["cdc_soft_delete_latest"]
ORACLE["stream_bronze_sink"] = ORACLE["cdc_unwrap"]

# ------------------------------------------------------------------ step 6
SAMPLES = """
WITH counters AS (
  SELECT ts, event_type AS metric, user_id AS series_id, event_id,
         sum(CAST(value AS DECIMAL(18,2))) OVER (
           PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
  FROM events),
gauges AS (
  SELECT ts, event_type AS metric, user_id AS series_id, event_id, value FROM events)
"""

ORACLE["counter_rate"] = SAMPLES + """
, l AS (SELECT *, lag(value) OVER (PARTITION BY metric, series_id ORDER BY ts, event_id) AS prev
        FROM counters),
d AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value
                     ELSE value - prev END AS delta FROM l),
r AS (SELECT *, sum(delta) OVER (PARTITION BY metric, series_id ORDER BY ts
                 RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW) AS increase FROM d)
SELECT ts, metric, series_id, event_id, CAST(value AS DOUBLE) AS value,
       CAST(delta AS DOUBLE) AS delta, CAST(increase AS DOUBLE) AS increase,
       CAST(increase AS DOUBLE) / CAST(300 AS DOUBLE) AS rate
FROM r"""

ORACLE["alert_intervals"] = SAMPLES + """
, s AS (SELECT *, coalesce(value > 30, false) AS on_ FROM gauges),
l AS (SELECT *, lag(on_) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS prev FROM s),
c AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> on_ THEN 1 ELSE 0 END) OVER (
        PARTITION BY series_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM l),
i AS (SELECT series_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_samples,
             CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE)
               AS duration_s
      FROM c WHERE on_ GROUP BY series_id, island)
SELECT *, start_ts + INTERVAL 60 SECOND AS fired_at FROM i WHERE duration_s >= 60"""

ORACLE["resample_grid"] = SAMPLES + """
, s AS (SELECT *, epoch_us(ts) AS t FROM gauges),
p AS (SELECT *, unnest(generate_series(
        CAST(ceil(CAST(t AS DOUBLE) / CAST(15000000 AS DOUBLE)) AS BIGINT),
        CAST(floor(CAST(t + 300000000 - 1 AS DOUBLE) / CAST(15000000 AS DOUBLE)) AS BIGINT))) AS g
      FROM s)
SELECT metric, series_id, make_timestamp(g * 15000000) AS eval_ts,
       arg_max(value, (ts, event_id)) AS value, max(ts) AS sample_ts
FROM p GROUP BY metric, series_id, g"""

ORACLE["last_not_null"] = SAMPLES + """
SELECT metric, series_id, arg_max(value, (ts, event_id)) AS last_value, max(ts) AS last_ts
FROM gauges WHERE value IS NOT NULL GROUP BY metric, series_id"""

ORACLE["threshold_step"] = """
SELECT event_id, value,
       CASE WHEN value >= 300 THEN 'red' WHEN value >= 100 THEN 'yellow' ELSE 'green' END AS colour
FROM events"""

ORACLE["label_match"] = """
SELECT event_id, event_type AS metric, CAST(user_id AS VARCHAR) AS user
FROM events WHERE regexp_full_match(CAST(user_id AS VARCHAR), '1[0-9]')"""

ORACLE["time_range"] = """
SELECT event_id, ts, event_type AS metric, value FROM events
WHERE ts >= TIMESTAMP '2024-01-15 06:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'"""

ORACLE["replication_lag"] = with_fixtures("""
, u AS (SELECT 'orders' AS "table", _synced_at FROM bronze_orders
        UNION ALL SELECT 'products', _synced_at FROM bronze_products
        UNION ALL SELECT 'users', _synced_at FROM bronze_users)
SELECT "table", max(_synced_at) AS last_synced_at,
       CAST(epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(max(_synced_at)) AS DOUBLE)
         / CAST(1000000 AS DOUBLE) AS lag_seconds
FROM u GROUP BY "table\"""")

ORACLE["rate_limit"] = """
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS requests
FROM events GROUP BY 1, 2 HAVING count(*) > 2"""

ORACLE["rate_limit_stream"] = ORACLE["rate_limit"]

# ------------------------------------------------------------------ step 7
AUDIT = """
WITH req AS (
  SELECT event_id AS request_id, ts AS "timestamp", 'user_' || CAST(user_id AS VARCHAR) AS user_name,
         CASE WHEN user_id % 3 = 0 THEN 'admin' ELSE 'analyst' END AS role,
         CASE event_type WHEN 'view' THEN 'list_dashboards' WHEN 'click' THEN 'get_dashboard_info'
              WHEN 'purchase' THEN 'list_datasets' WHEN 'signup' THEN 'create_chart'
              WHEN 'error' THEN 'delete_dataset' ELSE event_type END AS tool_name,
         props AS arguments
  FROM events),
grants(role, tool_name) AS (VALUES ('admin', 'list_dashboards'), ('admin', 'get_dashboard_info'),
                                   ('admin', 'list_datasets'), ('analyst', 'list_dashboards'),
                                   ('analyst', 'get_dashboard_info')),
dec AS (
  SELECT r.*, CASE WHEN g.role IS NOT NULL THEN 'GRANTED' ELSE 'DENIED - RBAC' END AS status
  FROM req r LEFT JOIN grants g ON r.role = g.role AND r.tool_name = g.tool_name),
log AS (SELECT "timestamp", user_name, tool_name, arguments, status FROM dec)
"""

ORACLE["authorize"] = AUDIT + "SELECT request_id, user_name, role, tool_name, status FROM dec"
ORACLE["audit_recent"] = AUDIT + """
SELECT * FROM log ORDER BY "timestamp" DESC, user_name DESC, tool_name DESC LIMIT 50"""
ORACLE["audit_total"] = AUDIT + "SELECT count(*) AS total FROM log"
ORACLE["audit_by_status"] = AUDIT + "SELECT status, count(*) AS count FROM log GROUP BY status"
ORACLE["audit_append"] = AUDIT + "SELECT * FROM log"

HISTORY = """
WITH hist AS (
  SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS x,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS y
  FROM orders GROUP BY 1),
seg AS (
  SELECT c_mktsegment AS segment,
         CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS x,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
"""

FIT = """
  count(*) AS n, sum(CAST(x AS BIGINT)) AS sx, sum(y) AS sy,
  sum(CAST(x AS BIGINT) * y) AS sxy, sum(CAST(x AS BIGINT) * x) AS sxx, max(x) AS max_x
"""

FIT_OUT = """
  , f2 AS (SELECT *, CASE WHEN CAST(n * sxx - sx * sx AS DOUBLE) <> 0
                          THEN CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE)
                     END AS slope FROM f),
  f3 AS (SELECT *, (CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept
         FROM f2)
"""

ORACLE["forecast_next"] = HISTORY + ", f AS (SELECT " + FIT + " FROM hist)" + FIT_OUT + """
SELECT round_even(slope * 1000000.0, 0) / 1000000.0 AS slope,
       round_even(intercept * 1000000.0, 0) / 1000000.0 AS intercept, CAST(max_x + 1 AS BIGINT) AS next_x,
       round_even((slope * CAST(max_x + 1 AS DOUBLE) + intercept) * 100.0, 0) / 100.0 AS prediction
FROM f3"""

ORACLE["forecast_by_segment"] = HISTORY + ", f AS (SELECT segment, " + FIT + \
    " FROM seg GROUP BY segment)" + FIT_OUT + """
SELECT segment, round_even(slope * 1000000.0, 0) / 1000000.0 AS slope,
       round_even(intercept * 1000000.0, 0) / 1000000.0 AS intercept, CAST(max_x + 1 AS BIGINT) AS next_x,
       round_even((slope * CAST(max_x + 1 AS DOUBLE) + intercept) * 100.0, 0) / 100.0 AS prediction
FROM f3"""

ORACLE["forecast_table"] = HISTORY + ", f AS (SELECT " + FIT + " FROM hist)" + FIT_OUT + """
SELECT '2024-01-31' AS fecha_prediccion, CAST(max_x + 1 AS BIGINT) AS mes_simulado,
       round_even((slope * CAST(max_x + 1 AS DOUBLE) + intercept) * 100.0, 0) / 100.0
         AS prediccion_ventas,
       'v1.1-dynamic' AS modelo_version
FROM f3"""

ORACLE["golden_sets"] = """
SELECT u.text AS query, a.text AS expected_sql
FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""

ORACLE["nearest_examples"] = """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings
           WHERE vec_id % 50 = 0),
e AS (SELECT vec_id AS example_id, CAST(embedding AS DOUBLE[]) AS ev, label FROM embeddings
      WHERE vec_id % 50 <> 0),
s AS (SELECT query_id, example_id, label, list_cosine_similarity(qv, ev) AS score FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank
      FROM s)
SELECT query_id, example_id, label, rank, round(score, 6) AS score FROM r WHERE rank <= 5"""

# ------------------------------------------------------------------ step 8
ORACLE["materialize_partitioned"] = with_fixtures(FCT_DOUBLE + """,
         CAST(year(order_date) * 100 + month(order_date) AS INTEGER) AS order_ym
FROM fct_sales""")

ORACLE["retention"] = with_fixtures("""
SELECT CAST(year(order_date) * 100 + month(order_date) AS INTEGER) AS order_ym,
       count(*) AS "rows", CAST(sum(amount_usd) AS DOUBLE) AS amount
FROM fct_sales WHERE year(order_date) * 100 + month(order_date) >= 199901 GROUP BY 1""")

ORACLE["compact"] = ORACLE["latest_by_key"]
ORACLE["compact_touched"] = ORACLE["latest_by_key"]

ORACLE["seed_if_empty"] = HISTORY + """
SELECT x AS historico_mes, CAST(y AS DOUBLE) AS ventas_reales FROM hist"""

ORACLE["run_medallion"] = ORACLE["sales_by_category_month"]

ORACLE["run_incremental"] = ORACLE["orders_by_status"]

ORACLE["alert_stream"] = SAMPLES + """
, s AS (SELECT *, coalesce(value > 30, false) AS on_ FROM gauges),
l AS (SELECT *, lag(on_) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS prev FROM s),
c AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> on_ THEN 1 ELSE 0 END) OVER (
        PARTITION BY series_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM l),
st AS (SELECT *, min(ts) OVER (PARTITION BY series_id, island) AS start_ts FROM c WHERE on_)
SELECT series_id, start_ts, min(ts) AS fired_ts FROM st
WHERE epoch_us(ts) - epoch_us(start_ts) >= 60000000 GROUP BY series_id, start_ts"""

ORACLE["users_by_country_month"] = with_fixtures("""
SELECT country, CAST(date_trunc('month', signup_date) AS DATE) AS createdAt_month, count(*) AS count
FROM stg_users GROUP BY 1, 2""")

ORACLE["sales_history_cube"] = HISTORY + """
SELECT x AS historicoMes, count(*) AS count, CAST(sum(y) AS DOUBLE) AS totalVentas,
       CAST(sum(y) AS DOUBLE) / count(y) AS promedioVentas
FROM hist GROUP BY x"""

FORECAST_ROWS = HISTORY + ", f AS (SELECT segment, " + FIT + \
    " FROM seg GROUP BY segment)" + FIT_OUT + """
, fr AS (SELECT '2024-01-31' AS fecha_prediccion, CAST(max_x + 1 AS BIGINT) AS mes_simulado,
       round_even((slope * CAST(max_x + 1 AS DOUBLE) + intercept) * 100.0, 0) / 100.0
         AS prediccion_ventas,
       'v1.1-dynamic-' || CAST(max_x + 1 AS VARCHAR) AS modelo_version
       FROM f3)
"""

ORACLE["forecast_cube"] = FORECAST_ROWS + """
SELECT modelo_version AS modeloVersion, count(*) AS count, sum(prediccion_ventas) AS totalPrediccion,
       sum(prediccion_ventas) / count(prediccion_ventas) AS promedioPrediccion
FROM fr GROUP BY 1"""

ORACLE["forecast_cube_named_source"] = ORACLE["forecast_cube"]

ORACLE["forecast_cube_drill"] = FORECAST_ROWS + """
SELECT modelo_version AS modeloVersion, fecha_prediccion AS fechaPrediccion, mes_simulado AS id
FROM fr"""

ORACLE["format_currency"] = with_fixtures("""
SELECT category, count(*) AS count,
       '$' || format('{:,.2f}', CAST(sum(amount_usd) AS DOUBLE)) AS totalAmount,
       '$' || format('{:,.2f}', CAST(sum(amount_usd) AS DOUBLE) / count(amount_usd)) AS avgOrderValue
FROM fct_sales GROUP BY category""")

ORACLE["capped_result"] = with_fixtures("""
SELECT order_id, category, CAST(amount_usd AS DOUBLE) AS amount_usd,
       (SELECT count(*) FROM fct_sales) > 5000 AS truncated
FROM fct_sales ORDER BY order_id LIMIT 5000""")

ORACLE["refresh_rollups"] = with_fixtures("""
SELECT order_status AS status, CAST(date_trunc('year', order_date) AS DATE) AS orderDate_year,
       count(*) AS count, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount
FROM fct_sales GROUP BY 1, 2""")

ORACLE["run_forecast"] = ORACLE["forecast_table"]

ORACLE["named_source_scan"] = """
SELECT p_brand, count(*) AS parts,
       CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(p_retailprice) AS avg_price
FROM part GROUP BY p_brand"""

ORACLE["create_as"] = with_fixtures("""
SELECT country, count(*) AS orders, CAST(sum(amount_usd) AS DOUBLE) AS amount
FROM fct_sales WHERE amount_usd > 50000 GROUP BY country""")

ORACLE["counter_rate_extrapolated"] = SAMPLES + """
, l AS (SELECT *, lag(value) OVER (PARTITION BY metric, series_id ORDER BY ts, event_id) AS prev
        FROM counters),
d AS (SELECT *, epoch_us(ts) AS t,
             CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS delta
      FROM l),
r AS (SELECT *,
        sum(delta) OVER w AS s, count(*) OVER w AS n, min(t) OVER w AS t_first,
        first_value(delta) OVER w AS d_first, first_value(value) OVER w AS v_first
      FROM d WINDOW w AS (PARTITION BY metric, series_id ORDER BY ts
                          RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CAST(s - d_first AS DOUBLE) AS inc,
             CAST(t - t_first AS DOUBLE) / CAST(1000000 AS DOUBLE) AS sampled,
             CAST(t_first - (t - 3600000000) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS to_start0
      FROM r),
y AS (SELECT *, sampled / CAST(n - 1 AS DOUBLE) AS avg_,
             CASE WHEN inc > 0 AND v_first >= 0
                   AND sampled * (CAST(v_first AS DOUBLE) / inc) < to_start0
                  THEN sampled * (CAST(v_first AS DOUBLE) / inc) ELSE to_start0 END AS to_start
      FROM x),
z AS (SELECT *, CASE WHEN n >= 2 AND sampled > 0 THEN inc * ((sampled +
             CASE WHEN to_start < avg_ * CAST(1.1 AS DOUBLE) THEN to_start
                  ELSE avg_ / CAST(2.0 AS DOUBLE) END) / sampled) END AS increase
      FROM y)
SELECT ts, metric, series_id, event_id, increase, increase / CAST(3600 AS DOUBLE) AS rate FROM z"""

ORACLE["counter_rate_double"] = SAMPLES + """
, c AS (SELECT * REPLACE (CAST(CAST(value * 100 AS BIGINT) AS DOUBLE) / CAST(64 AS DOUBLE) AS value) FROM counters),
l AS (SELECT *, lag(value) OVER (PARTITION BY metric, series_id ORDER BY ts, event_id) AS prev FROM c),
d AS (SELECT *, CASE WHEN prev IS NULL THEN CAST(0 AS DOUBLE) WHEN value < prev THEN value
                     ELSE value - prev END AS delta FROM l),
r AS (SELECT *, sum(delta) OVER (PARTITION BY metric, series_id ORDER BY ts
                 RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS increase FROM d)
SELECT ts, metric, series_id, event_id, value, delta, increase, increase / CAST(3600 AS DOUBLE) AS rate FROM r"""

RATE_GRID = SAMPLES + """
, l AS (SELECT *, lag(value) OVER (PARTITION BY metric, series_id ORDER BY ts, event_id) AS prev
        FROM counters WHERE ts IS NOT NULL AND value IS NOT NULL),
d AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS delta,
             CAST(floor(epoch_us(ts) / 15000000) AS BIGINT) AS pane FROM l),
p AS (SELECT *, unnest(generate_series(pane + 1, pane + 20)) AS g FROM d),
-- the first sample's own step began before the range
a AS (SELECT metric, series_id, g, count(*) AS samples,
             CAST(sum(delta) - arg_min(delta, (ts, event_id)) AS DOUBLE) AS increase
      FROM p GROUP BY metric, series_id, g)
SELECT metric, series_id, make_timestamp(g * 15000000) AS eval_ts, samples, increase,
       increase / CAST(300 AS DOUBLE) AS rate
FROM a"""

ORACLE["rate_grid"] = RATE_GRID

ORACLE["rate_grid_stream"] = RATE_GRID + """
WHERE make_timestamp(g * 15000000) <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)"""

ORACLE["business_day_events"] = """
SELECT CAST(timezone('America/Mexico_City', ts AT TIME ZONE 'UTC') AS DATE) AS business_date,
       count(*) AS events
FROM events GROUP BY 1"""

ORACLE["cdc_publication_ops"] = with_changes("SELECT * FROM changes WHERE op IN ('c', 'u')")

ORACLE["replication_lag_series"] = with_fixtures("""
, u AS (SELECT 'orders' AS "table", _synced_at FROM bronze_orders
        UNION ALL SELECT 'products', _synced_at FROM bronze_products
        UNION ALL SELECT 'users', _synced_at FROM bronze_users),
g AS (SELECT "table", time_bucket(INTERVAL 1 DAY, _synced_at) AS window_start,
             max(_synced_at) AS last_synced_at, count(*) AS "rows"
      FROM u GROUP BY 1, 2)
SELECT "table", window_start, window_start + INTERVAL 1 DAY AS window_end, last_synced_at, "rows",
       CAST(epoch_us(window_start + INTERVAL 1 DAY) - epoch_us(last_synced_at) AS DOUBLE)
         / CAST(1000000 AS DOUBLE) AS lag_seconds
FROM g""")

ORACLE["replication_lag_stream"] = ORACLE["replication_lag_series"]

ORACLE["sales_date_range_pruned"] = with_fixtures("""
SELECT country, CAST(date_trunc('week', order_date) AS DATE) AS orderDate_week,
       count(*) AS count, CAST(sum(amount_usd) AS DOUBLE) AS totalAmount
FROM fct_sales WHERE order_date BETWEEN DATE '1997-03-15' AND DATE '1997-06-10'
GROUP BY 1, 2""")

ORACLE["support_tickets_latest"] = """
SELECT id, user_id, subject, priority, status, updated_at, _offset, _synced_at FROM (
  SELECT user_id AS id, user_id, props AS subject,
         CASE WHEN value >= 100 THEN 'high' ELSE 'normal' END AS priority,
         CASE WHEN value >= 50 THEN 'open' ELSE 'closed' END AS status,
         ts AS updated_at, event_id AS _offset, ts AS _synced_at,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type = 'error') WHERE rn = 1"""

ORACLE["cube_named_source"] = with_fixtures("""
SELECT order_status AS status, country, count(*) AS count,
       CAST(sum(amount_usd) AS DOUBLE) / count(amount_usd) AS avgOrderValue
FROM fct_sales GROUP BY 1, 2""")

ORACLE["rate_limit_stream_append"] = """
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS requests
FROM events GROUP BY 1, 2
HAVING count(*) > 2
   AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""

ORACLE["stream_resume_exactly_once"] = ORACLE["cdc_unwrap"]

LAG_SAMPLES = with_fixtures("""
, s AS (SELECT 'orders' AS "table", _synced_at AS ts,
               CAST(date_diff('second', updated_at, _synced_at) AS DOUBLE) AS lag_seconds, id,
               product_id, supp_key, amount, quantity, discount, tax, _is_deleted
        FROM bronze_orders),
o AS (SELECT *, coalesce(lag_seconds > 10, false) AS on_ FROM s),
l AS (SELECT *, lag(on_) OVER (PARTITION BY "table" ORDER BY ts, id, product_id, supp_key,
                               amount, quantity, discount, tax, _is_deleted) AS prev FROM o),
c AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> on_ THEN 1 ELSE 0 END) OVER (
        PARTITION BY "table" ORDER BY ts, id, product_id, supp_key, amount, quantity, discount,
                                      tax, _is_deleted
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM l)
""")

ORACLE["replication_lag_alerts"] = LAG_SAMPLES + """
, i AS (SELECT "table", min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_samples,
               CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE)
                 AS duration_s
        FROM c WHERE on_ GROUP BY "table", island)
SELECT *, start_ts + INTERVAL 60 SECOND AS fired_at FROM i WHERE duration_s >= 60"""

ORACLE["replication_lag_alert_stream"] = LAG_SAMPLES + """
, st AS (SELECT *, min(ts) OVER (PARTITION BY "table", island) AS start_ts FROM c WHERE on_)
SELECT "table", start_ts, min(ts) AS fired_ts FROM st
WHERE epoch_us(ts) - epoch_us(start_ts) >= 60000000 GROUP BY "table", start_ts"""

STALE = SAMPLES + """
, s AS (SELECT *, coalesce(value > 30, false) AS on_ FROM gauges),
l AS (SELECT *, lag(on_) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS prev,
             lag(ts) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS prev_ts FROM s),
c AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> on_
                          OR epoch_us(ts) - epoch_us(prev_ts) > 21600000000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY series_id ORDER BY ts, event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM l)
"""

ORACLE["alert_intervals_stale"] = STALE + """
, i AS (SELECT series_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_samples,
               CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE)
                 AS duration_s
        FROM c WHERE on_ GROUP BY series_id, island)
SELECT *, start_ts + INTERVAL 60 SECOND AS fired_at FROM i WHERE duration_s >= 60"""

ORACLE["alert_stream_stale"] = STALE + """
, st AS (SELECT *, min(ts) OVER (PARTITION BY series_id, island) AS start_ts FROM c WHERE on_)
SELECT series_id, start_ts, min(ts) AS fired_ts FROM st
WHERE epoch_us(ts) - epoch_us(start_ts) >= 60000000 GROUP BY series_id, start_ts"""

# ------------------------------------------------------------------ round 2
ORACLE["cdc_key_only_delete"] = ORACLE["cdc_soft_delete_latest"]

ORACLE["cdc_bad_field_quarantine"] = with_changes("""
SELECT 'shop.public.orders' AS topic, CAST(id AS VARCHAR) AS key,
       CASE id % 4 WHEN 0 THEN '{"after":{"id":"abc"},"op":"u","ts_ms":1}'
                   WHEN 1 THEN '{"after":null,"op":"u","ts_ms":1}'
                   WHEN 2 THEN '{"op":"d","ts_ms":1}'
                   ELSE '{"after":{"id":1},"op":"x","ts_ms":1}' END AS value
FROM changes WHERE _offset = 1 AND id % 97 = 0
UNION ALL SELECT 'shop.public.orders', '-1', '{oops'""")

ORACLE["cdc_products_latest"] = """
SELECT p_partkey AS id, p_name AS name, ' ' || p_type AS category,
       CAST(CAST(p_retailprice AS DECIMAL(10,2)) + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS price,
       make_timestamp((946684800000 + CASE WHEN p_partkey % 3 = 0 THEN 86400000 ELSE 0 END + p_partkey) * 1000)
         AS updated_at,
       CASE WHEN p_partkey % 3 = 0 THEN 'u' ELSE 'r' END AS op
FROM part WHERE p_partkey % 7 <> 0"""

ORACLE["cdc_users_latest"] = with_fixtures("""
SELECT id, name, email, CASE WHEN id % 3 = 0 THEN 'MOVED' ELSE country END AS country, created_at,
       make_timestamp((946684800000 + CASE WHEN id % 3 = 0 THEN 86400000 ELSE 0 END + id) * 1000) AS updated_at,
       CASE WHEN id % 3 = 0 THEN 'u' ELSE 'r' END AS op
FROM bronze_users WHERE id % 7 <> 0""")

ORACLE["sales_by_business_day"] = with_fixtures("""
, s AS (SELECT *, CAST(timezone('America/Mexico_City', updated_at AT TIME ZONE 'UTC') AS DATE) AS business_date
        FROM latest_orders WHERE _is_deleted = 0 AND amount > 0 AND status <> 'weird')
SELECT business_date AS orderDate_day, count(*) AS count,
       CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS totalAmount
FROM s GROUP BY 1""")

ORACLE["replace_write_partitioned"] = ORACLE["retention"]

ORACLE["rls_drill"] = with_fixtures("""
SELECT order_id AS id FROM fct_sales
WHERE order_status = 'completed' AND country IN (SELECT country FROM rls_policy WHERE principal = 'ASIA')""")

ORACLE["rls_sql_view"] = with_fixtures("""
SELECT country, count(*) AS n, CAST(sum(amount_usd) AS DOUBLE) AS total FROM fct_sales
WHERE country IN (SELECT country FROM rls_policy WHERE principal = 'AFRICA') GROUP BY country""")

ORACLE["rollup_other_cube_ignored"] = with_fixtures("""
SELECT country, count(*) AS count FROM fct_sales GROUP BY country""")

ORACLE["rollup_empty_count"] = """
SELECT CAST(0 AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS totalAmount"""

ORACLE["count_if_measure"] = with_fixtures("""
SELECT country, CAST(date_trunc('quarter', order_date) AS DATE) AS orderDate_quarter, count(*) AS count,
       count(*) FILTER (WHERE is_completed = 1) AS completed, count(*) FILTER (WHERE amount_usd > 50000) AS large
FROM fct_sales GROUP BY 1, 2""")

ORACLE["forecast_double"] = HISTORY + """
SELECT count(*) AS n, round(regr_slope(CAST(y AS DOUBLE) / 1e15, CAST(x AS DOUBLE)) * 1e12, 4) AS slope_e12,
       round(regr_intercept(CAST(y AS DOUBLE) / 1e15, CAST(x AS DOUBLE)) * 1e9, 4) AS intercept_e9,
       CAST(max(x) AS BIGINT) AS max_x
FROM hist"""

ORACLE["forecast_rollup"] = FORECAST_ROWS + """
SELECT modelo_version AS modeloVersion, count(*) AS count, sum(prediccion_ventas) AS totalPrediccion
FROM fr GROUP BY 1"""

ORACLE["lag_series_gap"] = with_fixtures("""
, u AS (SELECT 'orders' AS "table", _synced_at FROM bronze_orders
        UNION ALL SELECT 'products', _synced_at FROM bronze_products
        UNION ALL SELECT 'users', _synced_at FROM bronze_users),
g AS (SELECT "table", time_bucket(INTERVAL 1 DAY, _synced_at) AS w, max(_synced_at) AS last_sync, count(*) AS n
      FROM u GROUP BY 1, 2),
grid AS (SELECT "table", unnest(generate_series(min(w), (SELECT max(w) FROM g), INTERVAL 1 DAY)) AS w
         FROM g GROUP BY "table"),
f AS (SELECT grid."table", grid.w, coalesce(g.n, 0) AS n,
             max(g.last_sync) OVER (PARTITION BY grid."table" ORDER BY grid.w) AS last_sync
      FROM grid LEFT JOIN g ON grid."table" = g."table" AND grid.w = g.w)
SELECT "table", w AS window_start, w + INTERVAL 1 DAY AS window_end, last_sync AS last_synced_at, n AS "rows",
       CAST(epoch_us(w + INTERVAL 1 DAY) - epoch_us(last_sync) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lag_seconds
FROM f""")

ORACLE["lag_series_gap_stream"] = ORACLE["lag_series_gap"]

# ------------------------------------------------------------------ round 3
ORACLE["rollup_signed_deltas"] = ORACLE["rollup_day_category"]

ORACLE["incremental_dimension_change"] = with_fixtures("""
SELECT category, CAST(date_trunc('year', order_date) AS DATE) AS orderDate_year, count(*) AS count,
       CAST(sum(amount_usd) AS DOUBLE) AS totalAmount, CAST(sum(gross_margin_usd) AS DOUBLE) AS grossMargin
FROM fct_sales GROUP BY 1, 2""")

ORACLE["alert_stream_silent"] = ORACLE["alert_stream"].partition("SELECT series_id, start_ts, min(ts) AS fired_ts")[0] + """
, f AS (SELECT series_id, start_ts, max(ts) AS last_ts,
               min(CASE WHEN epoch_us(ts) - epoch_us(start_ts) >= 60000000 THEN ts END) AS fired_ts
        FROM st GROUP BY series_id, start_ts),
e AS (SELECT series_id, island AS last_island FROM c
      QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, event_id DESC) = 1),
open_ AS (SELECT DISTINCT series_id, start_ts FROM st JOIN e USING (series_id) WHERE island = last_island)
SELECT series_id, start_ts, coalesce(fired_ts, start_ts + INTERVAL 60 SECOND) AS fired_ts
FROM f WHERE fired_ts IS NOT NULL OR (series_id, start_ts) IN (SELECT (series_id, start_ts) FROM open_)"""
