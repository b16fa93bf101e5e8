"""DuckDB SQL for every catalog query (the independent oracle).

The SQL restates each model over the driver's tables: the fixture adapters,
the staging projections and the marts as CTEs, then one final SELECT per
query key.  It is written from the model definitions, not generated from
the Spark plans.  Exact-arithmetic conventions match the engine's: money
is DECIMAL, means are rounded from integer cents, standard deviations come
from integer moments, gaps from integer microseconds.
"""

from __future__ import annotations

from ..operators.quality import CHECKS, Check
from ..schemas import RAW_SCHEMAS

DAY_US = 86_400_000_000


def rnd(expr: str, places: int, type_: str | None = None) -> str:
    """round half away from zero to ``places`` as DECIMAL (engine: ``round_to``)."""
    t = type_ or f"DECIMAL(38,{places})"
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {places}) AS {t})"


def sdiv(a: str, b: str) -> str:
    """a / nullif(b, 0) in double."""
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0.0))"


def hundredths(h: str) -> str:
    """Integer hundredths -> DECIMAL(18,2)."""
    return f"CAST(CAST({h} AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


def mean2(x: str) -> str:
    """Exact round(avg(x), 2) of a DECIMAL(·,2) column."""
    s = f"sum(CAST({x} * 100 AS BIGINT))"
    n = f"count({x})"
    q = f"((2 * abs({s}) + {n}) // (2 * {n}))"
    return hundredths(f"CASE WHEN {n} > 0 THEN (CASE WHEN {s} < 0 THEN -{q} ELSE {q} END) END")


def stddev_exact(x: str) -> str:
    """Sample stddev from exact integer moments of a DECIMAL(·,2) column."""
    k = f"CAST(CAST({x} * 100 AS BIGINT) AS DECIMAL(38,0))"
    n = f"CAST(count({x}) AS DECIMAL(38,0))"
    num = f"({n} * sum({k} * {k}) - sum({k}) * sum({k}))"
    den = f"({n} * ({n} - 1))"
    return f"(CASE WHEN count({x}) > 1 THEN sqrt(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE)) / 100.0 END)"


def vol4(x: str) -> str:
    """Volatility: stddev with NULL as 0, rounded to 4 places."""
    return rnd(f"coalesce({stddev_exact(x)}, 0.0)", 4, "DECIMAL(18,4)")


def gap2(g: str) -> str:
    """Gap days rounded to 2 places from integer microseconds."""
    q = f"((abs({g}) * 200 + {DAY_US}) // {2 * DAY_US})"
    return hundredths(f"CASE WHEN {g} < 0 THEN -{q} ELSE {q} END")


def whole_days(m: str) -> str:
    """Whole elapsed days from integer microseconds."""
    return f"(CASE WHEN {m} < 0 THEN -(abs({m}) // {DAY_US}) ELSE {m} // {DAY_US} END)"


def retention_ctes(prefix: str, mapping: str) -> str:
    """Retention facts and labels over an order mapping (order_id, purchase_at, customer_unique_id)."""
    w = "PARTITION BY customer_unique_id ORDER BY purchase_at ASC NULLS LAST, order_id"
    return f"""
{prefix}_calc AS (
  SELECT m.customer_unique_id, m.order_id, m.purchase_at, d.max_data_date,
         lag(m.purchase_at) OVER ({w}) AS previous_order_at,
         CAST(row_number() OVER ({w}) AS BIGINT) AS order_sequence,
         CAST(count(*) OVER (PARTITION BY customer_unique_id) AS BIGINT) AS total_customer_orders
  FROM {mapping} m CROSS JOIN (SELECT max(purchase_at) AS max_data_date FROM {mapping}) d
),
{prefix}_facts AS (
  SELECT customer_unique_id, order_id, purchase_at, previous_order_at, order_sequence, total_customer_orders,
         (epoch_us(purchase_at) - epoch_us(previous_order_at)) AS gap_micros,
         {gap2("(epoch_us(purchase_at) - epoch_us(previous_order_at))")} AS days_between_orders,
         CAST({whole_days("(epoch_us(max_data_date) - epoch_us(purchase_at))")} AS BIGINT) AS recency_days
  FROM {prefix}_calc
),
{prefix} AS (
  SELECT customer_unique_id, order_id, purchase_at AS most_recent_purchase_at, previous_order_at,
         coalesce(order_sequence, 0) AS order_sequence,
         coalesce(total_customer_orders, 0) AS total_customer_orders,
         days_between_orders, recency_days,
         CASE WHEN order_sequence > 1 THEN 'Repeat Transaction'
              WHEN order_sequence = 1 AND total_customer_orders > 1 THEN 'Initial Purchase (Loyalist)'
              WHEN total_customer_orders = 1 AND recency_days > 365 THEN 'Lapsed (One-Time)'
              WHEN total_customer_orders = 1 AND recency_days <= 365 THEN 'New (Potential Repeat)'
              ELSE 'No Order' END AS lifecycle_stage,
         CASE WHEN order_sequence = 1 THEN 'First Order'
              WHEN gap_micros <= {30 * DAY_US} THEN 'Quick Return (<30d)'
              WHEN gap_micros <= {90 * DAY_US} THEN 'Standard (30-90d)'
              ELSE 'Delayed (>90d)' END AS retention_window
  FROM {prefix}_facts
)"""


CTES = f"""
WITH
raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'F' THEN 'delivered'
              WHEN o_orderstatus = 'O' THEN 'shipped'
              WHEN o_orderpriority = '5-LOW' THEN 'unavailable'
              WHEN o_orderpriority = '1-URGENT' THEN 'canceled'
              ELSE 'processing' END AS order_status,
         CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey * 7919) % 86400) AS order_purchase_timestamp,
         CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey * 7919) % 86400) + to_seconds((o_orderkey * 31) % 7200) AS order_approved_at,
         CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY END AS order_delivered_carrier_date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 7 DAY END AS order_delivered_customer_date,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 DAY AS order_estimated_delivery_date
  FROM orders
),
raw_customers AS (
  SELECT c_custkey AS customer_id, c_custkey // 2 AS customer_unique_id,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
         'city_' || CAST(c_nationkey AS VARCHAR) AS customer_city,
         c_mktsegment AS customer_state
  FROM customer
),
raw_order_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
         CAST(l_shipdate AS TIMESTAMP) AS shipping_limit_date,
         CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS price,
         CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(4,2)) + CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS freight_value
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
raw_products AS (
  SELECT p_partkey AS product_id, nullif(p_type, 'PROMO') AS product_category_name,
         CAST(length(p_name) AS DOUBLE) AS product_name_lenght,
         CAST(length(p_brand) AS DOUBLE) AS product_description_lenght,
         CAST(1.0 AS DOUBLE) AS product_photos_qty,
         CAST(p_size * 100 AS DOUBLE) AS product_weight_g,
         CAST(p_size AS DOUBLE) AS product_length_cm,
         CAST(10.0 AS DOUBLE) AS product_height_cm,
         CAST(5.0 AS DOUBLE) AS product_width_cm
  FROM part
),
raw_translation AS (
  SELECT DISTINCT p_type AS product_category_name, p_type || ' goods' AS product_category_name_english
  FROM part WHERE p_type IN ('STANDARD', 'ECONOMY', 'MEDIUM', 'SMALL')
),
raw_order_payments AS (
  SELECT o_orderkey AS order_id, n AS payment_sequential,
         CASE WHEN n = 2 THEN 'voucher' WHEN o_orderpriority = '5-LOW' THEN 'boleto' ELSE 'credit_card' END AS payment_type,
         CAST(o_orderkey % 12 + 1 AS INTEGER) AS payment_installments,
         CAST(CASE WHEN n = 2 THEN voucher WHEN o_orderkey % 5 = 0 THEN total - voucher ELSE total END AS DECIMAL(18,2)) AS payment_value
  FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.25 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS voucher,
               unnest(CASE WHEN o_orderkey % 5 = 0 THEN [1, 2] ELSE [1] END) AS n
        FROM orders)
),
raw_order_reviews AS (
  SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS review_id, o_orderkey AS order_id,
         CAST(o_orderkey % 5 + 1 AS INTEGER) AS review_score,
         CASE WHEN o_orderkey % 3 = 0 THEN 'title, ' || o_orderstatus END AS review_comment_title,
         CASE WHEN o_orderkey % 4 <> 0
              THEN 'the "' || o_orderpriority || '" order,' || chr(10) || 'number ' || CAST(o_orderkey AS VARCHAR) || ', came' END AS review_comment_message,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 8 DAY AS review_creation_date,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 DAY AS review_answer_timestamp
  FROM orders
),
raw_geolocation AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
         CAST(c_custkey % 720 AS DOUBLE) / 4.0 - 90.0 AS geolocation_lat,
         CAST(c_custkey % 1440 AS DOUBLE) / 4.0 - 180.0 AS geolocation_lng,
         'city_' || CAST(c_nationkey AS VARCHAR) AS geolocation_city,
         c_mktsegment AS geolocation_state
  FROM customer
),
raw_sellers AS (
  SELECT s_suppkey AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
         s_name AS seller_city, CAST(s_nationkey AS VARCHAR) AS seller_state
  FROM supplier
),
purchase_events AS (
  SELECT event_id AS order_id, CAST(ts AS TIMESTAMP) AS purchase_at, user_id AS customer_unique_id
  FROM events WHERE event_type = 'purchase'
),
stg_category_translate AS (
  SELECT product_category_name AS category_name_pt, product_category_name_english AS category_name_en FROM raw_translation
),
stg_customer AS (
  SELECT customer_id, customer_unique_id, customer_zip_code_prefix AS zip_code, customer_city, customer_state FROM raw_customers
),
stg_order AS (
  SELECT order_id, customer_id, order_status,
         CAST(order_purchase_timestamp AS TIMESTAMP) AS purchase_at,
         CAST(order_approved_at AS TIMESTAMP) AS approved_at,
         CAST(order_delivered_carrier_date AS TIMESTAMP) AS delivered_to_carrier_at,
         CAST(order_delivered_customer_date AS TIMESTAMP) AS delivered_to_customer_at,
         CAST(order_estimated_delivery_date AS TIMESTAMP) AS estimated_delivery_at
  FROM raw_orders
),
stg_order_items AS (
  SELECT order_id, order_item_id, product_id, seller_id, price, freight_value, (price + freight_value) AS total_item_cost
  FROM raw_order_items
),
stg_products AS (
  SELECT product_id, product_category_name, product_name_lenght AS name_length,
         product_description_lenght AS description_length, product_photos_qty AS photos_qty,
         product_weight_g AS weight_g, product_length_cm AS length_cm, product_height_cm AS height_cm,
         product_width_cm AS width_cm
  FROM raw_products
),
stg_sellers AS (
  SELECT seller_id, seller_zip_code_prefix AS zip, seller_city, seller_state FROM raw_sellers
),
order_totals AS (
  SELECT order_id,
         CAST(sum(price) AS DECIMAL(38,2)) AS total_price,
         CAST(sum(freight_value) AS DECIMAL(38,2)) AS total_freight,
         CAST(sum(total_item_cost) AS DECIMAL(38,2)) AS total_order_amount,
         count(product_id) AS total_items
  FROM stg_order_items GROUP BY order_id
),
fct_orders AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.purchase_at,
         CAST(coalesce(t.total_price, 0) AS DECIMAL(38,2)) AS total_price,
         CAST(coalesce(t.total_freight, 0) AS DECIMAL(38,2)) AS total_freight,
         CAST(coalesce(t.total_order_amount, 0) AS DECIMAL(38,2)) AS total_order_amount,
         CAST(coalesce(t.total_items, 0) AS BIGINT) AS total_items
  FROM stg_order o LEFT JOIN order_totals t USING (order_id)
),
dim_products AS (
  SELECT p.product_id, coalesce(t.category_name_en, p.product_category_name) AS category_name,
         p.weight_g, p.length_cm, p.height_cm, p.width_cm,
         (p.length_cm * p.height_cm * p.width_cm) AS volume_cm3
  FROM stg_products p LEFT JOIN stg_category_translate t ON p.product_category_name = t.category_name_pt
),
customers_unique AS (
  SELECT customer_unique_id,
         arg_min(customer_city, customer_id) AS customer_city,
         arg_min(customer_state, customer_id) AS customer_state
  FROM stg_customer GROUP BY customer_unique_id
),
order_stats AS (
  SELECT c.customer_unique_id,
         min(o.purchase_at) AS first_order_date,
         max(o.purchase_at) AS last_order_date,
         count(o.order_id) AS total_orders,
         CAST(sum(o.total_order_amount) AS DECIMAL(38,2)) AS lifetime_value,
         {mean2("o.total_order_amount")} AS average_order_value
  FROM fct_orders o JOIN stg_customer c USING (customer_id)
  GROUP BY c.customer_unique_id
),
dim_customer AS (
  SELECT c.customer_unique_id, c.customer_city, c.customer_state, s.first_order_date, s.last_order_date,
         CAST(coalesce(s.total_orders, 0) AS BIGINT) AS total_orders,
         CAST(coalesce(s.lifetime_value, 0) AS DECIMAL(38,2)) AS lifetime_value,
         CAST(coalesce(s.average_order_value, 0) AS DECIMAL(18,2)) AS average_order_value,
         CASE WHEN s.lifetime_value >= 3000 THEN 'VIP'
              WHEN s.lifetime_value >= 1000 THEN 'High Value'
              WHEN s.lifetime_value >= 200 THEN 'Medium Value'
              WHEN s.lifetime_value > 0 THEN 'Low Value'
              ELSE 'Lead / No Purchase' END AS customer_segment
  FROM customers_unique c LEFT JOIN order_stats s USING (customer_unique_id)
),
monthly_revenue AS (
  SELECT CAST(date_trunc('month', purchase_at) AS DATE) AS order_month,
         count(order_id) AS total_fullfilled_orders,
         CAST(sum(total_order_amount) AS DECIMAL(38,2)) AS revenue,
         CAST(sum(total_items) AS BIGINT) AS items_sold
  FROM fct_orders
  WHERE order_status NOT IN ('canceled', 'unavailable') AND total_order_amount > 0
  GROUP BY 1
),
monthly_revenue_by_cat AS (
  SELECT CAST(date_trunc('month', o.purchase_at) AS DATE) AS revenue_month,
         CAST(year(o.purchase_at) AS BIGINT) AS revenue_year,
         CAST(month(o.purchase_at) AS BIGINT) AS revenue_month_num,
         strftime(o.purchase_at, '%Y-%m') AS revenue_year_month,
         coalesce(ct.category_name_en, 'Unknown') AS product_category,
         CAST(sum(oi.total_item_cost) AS DECIMAL(38,2)) AS monthly_revenue,
         count(oi.product_id) AS product_sold
  FROM stg_order o
  JOIN stg_order_items oi USING (order_id)
  JOIN stg_products p USING (product_id)
  LEFT JOIN stg_category_translate ct ON p.product_category_name = ct.category_name_pt
  GROUP BY 1, 2, 3, 4, 5
),
product_moments AS (
  SELECT product_id, count(*) AS sales_count,
         {mean2("price")} AS avg_price,
         {mean2("freight_value")} AS avg_freight,
         {mean2("total_item_cost")} AS avg_total_cost,
         {vol4("price")} AS price_volatility,
         {vol4("freight_value")} AS freight_volatility,
         {vol4("total_item_cost")} AS total_cost_volatility
  FROM stg_order_items GROUP BY product_id
),
product_base_stats AS (
  SELECT p.product_id, coalesce(p.category_name, 'Unknown') AS category, count(*) AS sales_count,
         {mean2("oi.price")} AS avg_price,
         {mean2("oi.freight_value")} AS avg_freight,
         {mean2("oi.total_item_cost")} AS avg_total_cost,
         CASE WHEN count(*) = 1 THEN 'Single Sale' WHEN count(*) < 4 THEN 'Low Confidence' ELSE 'High Confidence' END AS reliability_score,
         {vol4("oi.price")} AS price_volatility,
         {vol4("oi.freight_value")} AS freight_volatility,
         {vol4("oi.total_item_cost")} AS total_cost_volatility
  FROM stg_order_items oi JOIN dim_products p USING (product_id)
  GROUP BY 1, 2
),
category_benchmarks AS (
  SELECT category,
         CAST(sum(avg_total_cost) AS DOUBLE) / CAST(count(avg_total_cost) AS DOUBLE) AS cat_avg_total_cost,
         {stddev_exact("avg_total_cost")} AS cat_stddev_total_cost,
         CAST(sum(avg_freight) AS DOUBLE) / CAST(count(avg_freight) AS DOUBLE) AS cat_avg_freight_share
  FROM product_base_stats GROUP BY category
),
category_analysis AS (
  SELECT b.*, {sdiv("b.avg_freight", "b.avg_total_cost")} * 100.0 AS freight_share_pct,
         cb.cat_avg_total_cost, cb.cat_stddev_total_cost, cb.cat_avg_freight_share,
         coalesce(b.total_cost_volatility < (b.price_volatility + b.freight_volatility) * CAST(0.3 AS DECIMAL(2,1))
                  AND b.sales_count > 1
                  AND (b.price_volatility > 0 OR b.freight_volatility > 0), false) AS is_price_rebalanced
  FROM product_base_stats b LEFT JOIN category_benchmarks cb USING (category)
),
cost_features AS (
  SELECT *,
         (CAST(avg_total_cost AS DOUBLE) - cat_avg_total_cost) / nullif(cat_stddev_total_cost, 0.0) AS total_cost_z_score,
         (freight_share_pct - cat_avg_freight_share) AS freight_pct_diff_from_avg,
         {sdiv("total_cost_volatility", "avg_total_cost")} AS total_cost_cv,
         CAST(avg_price * sales_count AS DECIMAL(38,2)) AS product_revenue
  FROM category_analysis
),
pareto_analysis AS (
  SELECT *,
         sum(product_revenue) OVER (PARTITION BY category ORDER BY product_revenue DESC NULLS FIRST) AS cumulative_category_revenue,
         sum(product_revenue) OVER (PARTITION BY category) AS total_category_revenue
  FROM cost_features
),
product_cost_decomposition AS (
  SELECT *,
         {rnd(sdiv("product_revenue", "total_category_revenue") + " * 100.0", 4)} AS product_revenue_share_pct,
         {rnd(sdiv("cumulative_category_revenue", "total_category_revenue") + " * 100.0", 4)} AS pareto_revenue_pct,
         coalesce(CASE WHEN total_category_revenue <> 0 THEN cumulative_category_revenue * 5 <= total_category_revenue * 4 END, false) AS is_revenue_workhorse
  FROM pareto_analysis
),
order_mapping AS (
  SELECT o.order_id, o.purchase_at, c.customer_unique_id
  FROM fct_orders o JOIN stg_customer c USING (customer_id)
),
{retention_ctes("customer_retention", "order_mapping")},
{retention_ctes("event_retention", "purchase_events")}
"""

_PCD_COLS = """product_id, category, sales_count, avg_price, avg_freight, avg_total_cost, reliability_score,
 price_volatility, freight_volatility, total_cost_volatility, freight_share_pct, cat_avg_total_cost,
 cat_stddev_total_cost, cat_avg_freight_share, is_price_rebalanced, total_cost_z_score,
 freight_pct_diff_from_avg, total_cost_cv, product_revenue, cumulative_category_revenue,
 total_category_revenue, product_revenue_share_pct, pareto_revenue_pct, is_revenue_workhorse"""

SEL_CATS = "('STANDARD goods', 'ECONOMY goods', 'Unknown')"
SEL_YEARS = "(1996, 1997, 1998)"


def _hist(src: str, col: str, width: float, start: float = 0.0) -> str:
    b = f"CAST(floor((CAST({col} AS DOUBLE) - {start}) / {width}) AS BIGINT)"
    return f"""SELECT bin, CAST(bin AS DOUBLE) * {width} + {start} AS bin_start, CAST(bin AS DOUBLE) * {width} + {start} + {width} AS bin_end, count
FROM (SELECT {b} AS bin, count(*) AS count FROM {src} WHERE {col} IS NOT NULL GROUP BY 1)"""


def _check_sql(c: Check) -> str:
    head = f"'{c.model}' AS model, '{c.column}' AS column_name, '{c.test}' AS test_name"
    src = {"orders": "stg_order", "product_cost_decomposition": "product_cost_decomposition"}.get(c.model, c.model)
    col = c.column
    if c.test == "unique":
        return (
            f"SELECT {head}, CAST(count(*) AS BIGINT) AS failures FROM "
            f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) > 1)"
        )
    if c.test == "accepted_values":
        vals = ", ".join(("true" if v else "false") if isinstance(v, bool) else f"'{v}'" for v in c.values)
        return (
            f"SELECT {head}, CAST(count(*) AS BIGINT) AS failures FROM "
            f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL AND {col} NOT IN ({vals}) GROUP BY {col})"
        )
    if c.test == "not_null":
        cond = f"{col} IS NULL"
    elif c.test == "accepted_range":
        parts = []
        if c.min_value is not None:
            parts.append(f"{col} {'<' if c.inclusive else '<='} {c.min_value}")
        if c.max_value is not None:
            parts.append(f"{col} {'>' if c.inclusive else '>='} {c.max_value}")
        cond = f"{col} IS NOT NULL AND ({' OR '.join(parts)})"
    else:
        cond = f"({c.where}) AND NOT coalesce({col} {c.expression}, true)"
    return f"SELECT {head}, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS failures FROM {src}"


def _dq_report() -> str:
    body = "\nUNION ALL\n".join(_check_sql(c) for c in CHECKS)
    return f"SELECT *, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({body})"


def _content(name: str, label: str, source: str, columns: list[str]) -> str:
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '?')" for c in columns)
    digest = f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT)"
    return f"SELECT '{name}' AS {label}, count(*) AS row_count, CAST(coalesce(sum({digest}), 0) AS BIGINT) AS content FROM {source}"


def _nice_hist(src: str, col: str, most: int) -> str:
    """Bins of the least width 1, 2 or 5 times a power of ten that needs at most ``most`` of them, in whole billionths."""
    nano = lambda x: f"CAST(CAST({x} AS DECIMAL(38,9)) * 1000000000 AS HUGEINT)"
    below = lambda x: f"(({x} - (({x} % w) + w) % w) // w)"
    edge = lambda n: f"CAST(CAST({n} * w AS DECIMAL(38,0)) * CAST(0.000000001 AS DECIMAL(9,9)) AS DECIMAL(28,9))"
    return f"""SELECT CAST(bin AS BIGINT) AS bin, {edge('bin')} AS bin_start, {edge('(bin + 1)')} AS bin_end, count(*) AS count
        FROM (SELECT w, {below('x')} AS bin FROM (SELECT {nano(col)} AS x FROM {src}),
              (SELECT coalesce(min(w), 1000000000) AS w
               FROM (SELECT CAST(step AS HUGEINT) * CAST(pow(10, power) AS HUGEINT) AS w FROM (VALUES (1), (2), (5)) s(step), range(0, 16) p(power)),
                    (SELECT {nano(f'min({col})')} AS lo, {nano(f'max({col})')} AS hi FROM {src})
               WHERE lo < hi AND {below('hi')} - {below('lo')} + 1 <= {most}))
        WHERE bin IS NOT NULL GROUP BY bin, w"""


def _ingest_all() -> str:
    source = {"product_category_name_translation": "raw_translation"}
    return "\nUNION ALL\n".join(_content(t, "table_name", source.get(t, f"raw_{t}"), s.fieldNames()) for t, s in RAW_SCHEMAS.items())


#: Columns of each mart in the whole-build report.
_BUILD = {
    "fct_orders": "order_id customer_id order_status total_items",
    "dim_products": "product_id category_name",
    "dim_customer": "customer_unique_id total_orders customer_segment",
    "monthly_revenue": "order_month total_fullfilled_orders revenue",
    "monthly_revenue_by_cat": "revenue_month product_category monthly_revenue product_sold",
    "product_cost_decomposition": "product_id category sales_count product_revenue is_revenue_workhorse",
    "customer_retention": "order_id order_sequence lifecycle_stage retention_window",
}


def _build_all() -> str:
    return "\nUNION ALL\n".join(_content(t, "mart", t, c.split()) for t, c in _BUILD.items())


_AUDIT_COLS = "product_id, category, is_revenue_workhorse, product_revenue_share_pct, avg_price, total_cost_z_score, sales_count, is_price_rebalanced"

FINAL: dict[str, str] = {
    # sources / sinks
    "ingest_csv": "SELECT * FROM stg_order",
    "normalize_columns": "SELECT * FROM raw_customers",
    "raw_roundtrip": "SELECT * FROM raw_order_items",
    "load_report": """SELECT 'orders' AS table_name, count(*) AS row_count FROM raw_orders
        UNION ALL SELECT 'order_items', count(*) FROM raw_order_items
        UNION ALL SELECT 'customers', count(*) FROM raw_customers
        UNION ALL SELECT 'products', count(*) FROM raw_products
        UNION ALL SELECT 'sellers', count(*) FROM raw_sellers
        UNION ALL SELECT 'product_category_name_translation', count(*) FROM raw_translation
        UNION ALL SELECT 'order_payments', count(*) FROM raw_order_payments
        UNION ALL SELECT 'order_reviews', count(*) FROM raw_order_reviews
        UNION ALL SELECT 'geolocation', count(*) FROM raw_geolocation""",
    "ingest_all": _ingest_all(),
    "build_all": _build_all(),
    "mart_roundtrip": "SELECT * FROM fct_orders",
    "build_bucketed": "\nUNION ALL\n".join(_content(t, "mart", t, _BUILD[t].split()) for t in ("dim_customer", "customer_retention")),
    "mart_reuse": "SELECT revenue_month, product_category, monthly_revenue FROM monthly_revenue_by_cat WHERE revenue_year >= 1996",
    "table_versions": """SELECT CAST(4 - least AS BIGINT) AS version, count(*) AS row_count, CAST(sum(price) AS DECIMAL(38,2)) AS price
        FROM raw_order_items JOIN (VALUES (2), (1)) t(least) ON order_id % 4 >= least GROUP BY least""",
    "ingest_rejects": _content("(good)", '"column"', "(SELECT * FROM raw_order_items WHERE order_id % 50 <> 0 AND order_id % 75 <> 0)", ["order_id", "order_item_id", "product_id", "price"])
    + """
        UNION ALL SELECT 'price', count(*), CAST(sum(len('EUR ' || CAST(price AS VARCHAR))) AS BIGINT) FROM raw_order_items WHERE order_id % 50 = 0
        UNION ALL SELECT 'order_item_id', count(*), CAST(sum(len('one, or two')) AS BIGINT) FROM raw_order_items WHERE order_id % 75 = 0""",
    "mart_scan": "SELECT revenue_month, product_category, monthly_revenue FROM monthly_revenue_by_cat",
    "mart_category_year": f"SELECT * FROM monthly_revenue_by_cat WHERE product_category IN {SEL_CATS} AND revenue_year IN {SEL_YEARS}",
    # staging
    "stg_category_translate": "SELECT * FROM stg_category_translate",
    "stg_customer": "SELECT * FROM stg_customer",
    "stg_order": "SELECT * FROM stg_order",
    "stg_order_items": "SELECT * FROM stg_order_items",
    "stg_products": "SELECT * FROM stg_products",
    "stg_sellers": "SELECT * FROM stg_sellers",
    # filters
    "flt_status": "SELECT * FROM fct_orders WHERE order_status NOT IN ('canceled', 'unavailable')",
    "flt_positive_amount": "SELECT * FROM fct_orders WHERE total_order_amount > 0",
    "flt_categories": f"SELECT product_id, category, product_revenue FROM product_cost_decomposition WHERE category IN {SEL_CATS}",
    "flt_category_year": f"SELECT * FROM monthly_revenue_by_cat WHERE product_category IN {SEL_CATS} AND revenue_year IN {SEL_YEARS}",
    "flt_reliable": "SELECT product_id, category, sales_count, reliability_score FROM product_cost_decomposition WHERE reliability_score <> 'Single Sale'",
    "flt_workhorse": "SELECT product_id, category, product_revenue, pareto_revenue_pct FROM product_cost_decomposition WHERE is_revenue_workhorse",
    "flt_repeat": "SELECT order_id, customer_unique_id, order_sequence FROM customer_retention WHERE order_sequence > 1",
    "flt_true_repeat": "SELECT order_id, customer_unique_id, days_between_orders FROM event_retention WHERE order_sequence > 1 AND days_between_orders > 0.05",
    "true_repeats": "SELECT * FROM event_retention WHERE order_sequence > 1 AND days_between_orders > 0.05",
    # joins
    "join_orders_items": "SELECT o.order_id, o.customer_id, t.total_price, t.total_freight, t.total_order_amount, t.total_items FROM stg_order o LEFT JOIN order_totals t USING (order_id)",
    "join_translation": "SELECT p.product_category_name, p.product_id, t.category_name_en FROM stg_products p LEFT JOIN stg_category_translate t ON p.product_category_name = t.category_name_pt",
    "join_fact_customer": "SELECT o.customer_id, o.order_id, o.total_order_amount, c.customer_unique_id FROM fct_orders o JOIN stg_customer c USING (customer_id)",
    "join_person_stats": "SELECT c.customer_unique_id, c.customer_city, c.customer_state, s.total_orders, s.lifetime_value FROM customers_unique c LEFT JOIN order_stats s USING (customer_unique_id)",
    "cross_max_date": "SELECT m.*, d.max_data_date FROM order_mapping m CROSS JOIN (SELECT max(purchase_at) AS max_data_date FROM order_mapping) d",
    "join_order_item_product": "SELECT oi.product_id, o.order_id, o.purchase_at, oi.order_item_id, oi.total_item_cost, p.product_category_name FROM stg_order o JOIN stg_order_items oi USING (order_id) JOIN stg_products p USING (product_id)",
    "join_items_dim": "SELECT oi.product_id, oi.order_id, oi.order_item_id, oi.price, p.category_name FROM stg_order_items oi JOIN dim_products p USING (product_id)",
    "order_mapping": "SELECT * FROM order_mapping",
    # aggregates
    "agg_order_totals": "SELECT * FROM order_totals",
    "agg_customer_stats": "SELECT * FROM order_stats",
    "agg_max_date": "SELECT max(purchase_at) AS max_data_date FROM order_mapping",
    "agg_month": """SELECT CAST(date_trunc('month', purchase_at) AS DATE) AS order_month, count(order_id) AS total_fullfilled_orders,
        CAST(sum(total_order_amount) AS DECIMAL(38,2)) AS revenue, CAST(sum(total_items) AS BIGINT) AS items_sold FROM fct_orders GROUP BY 1""",
    "agg_month_category": "SELECT revenue_month, product_category, monthly_revenue, product_sold FROM monthly_revenue_by_cat",
    "agg_product_means": "SELECT product_id, sales_count, avg_price, avg_freight, avg_total_cost FROM product_moments",
    "agg_product_volatility": "SELECT product_id, price_volatility, freight_volatility, total_cost_volatility FROM product_moments",
    "distinct_on_person": "SELECT * FROM customers_unique",
    "hist_recency_nice": _nice_hist("customer_retention", "recency_days", 50),
    "hist_gap_nice": _nice_hist("(SELECT * FROM event_retention WHERE order_sequence > 1 AND days_between_orders > 0.05)", "days_between_orders", 200),
    "kpi_unique_customers_sketch": """SELECT year(most_recent_purchase_at) AS year, count(*) AS orders, count(DISTINCT customer_unique_id) AS persons, true AS within_bound
        FROM customer_retention GROUP BY 1""",
    "flt_many_products": "SELECT product_id, category, sales_count FROM product_cost_decomposition WHERE product_id < 300000 AND product_id % 3 = 0",
    "kpi_unique_customers": "SELECT CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS total_customers FROM customer_retention",
    "distinct_categories": "SELECT DISTINCT category FROM product_cost_decomposition",
    "distinct_years": "SELECT DISTINCT CAST(revenue_year AS INTEGER) AS revenue_year FROM monthly_revenue_by_cat",
    "kpi_repeat_rate": f"""SELECT orders, repeat_orders, {rnd(sdiv('repeat_orders', 'orders') + ' * 100.0', 2)} AS repeat_rate_pct
        FROM (SELECT count(*) AS orders, count(*) FILTER (WHERE order_sequence > 1) AS repeat_orders FROM customer_retention)""",
    "customer_repeat_rate": f"""SELECT customers, repeat_customers, {rnd(sdiv('repeat_customers', 'customers') + ' * 100.0', 2)} AS customer_repeat_rate_pct
        FROM (SELECT count(*) AS customers, count(*) FILTER (WHERE n > 1) AS repeat_customers
              FROM (SELECT customer_unique_id, max(total_customer_orders) AS n FROM customer_retention GROUP BY 1))""",
    "lifecycle_distribution": f"""SELECT lifecycle_stage, orders, {rnd(sdiv('orders', 'total') + ' * 100.0', 2)} AS share_pct
        FROM (SELECT lifecycle_stage, count(*) AS orders FROM customer_retention GROUP BY 1)
        CROSS JOIN (SELECT count(*) AS total FROM customer_retention)""",
    "hist_recency": _hist("customer_retention", "recency_days", 50.0),
    "hist_gap": _hist("(SELECT * FROM event_retention WHERE order_sequence > 1 AND days_between_orders > 0.05)", "days_between_orders", 0.5),
    "yearly_avg_revenue": f"SELECT product_category, revenue_year, {mean2('monthly_revenue')} AS avg_monthly_revenue FROM monthly_revenue_by_cat GROUP BY 1, 2",
    "kpi_pareto": f"""SELECT total_products, workhorse_products, {rnd(sdiv('workhorse_products', 'total_products') + ' * 100.0', 1)} AS inventory_pct
        FROM (SELECT count(*) AS total_products, count(*) FILTER (WHERE is_revenue_workhorse) AS workhorse_products FROM product_cost_decomposition)""",
    "kpi_same_day": """SELECT same_day_orders, credible_same_day_orders, same_day_orders - credible_same_day_orders AS technical_splits
        FROM (SELECT count(*) FILTER (WHERE order_sequence > 1 AND coalesce(days_between_orders, 0) < 1) AS same_day_orders,
                     count(*) FILTER (WHERE order_sequence > 1 AND days_between_orders > 0.05 AND days_between_orders < 1) AS credible_same_day_orders
              FROM event_retention)""",
    "max_gap": """SELECT max_gap_days, CAST(max_gap_days * CAST(1.05 AS DECIMAL(3,2)) AS DECIMAL(20,4)) AS axis_max
        FROM (SELECT max(days_between_orders) AS max_gap_days FROM event_retention WHERE order_sequence > 1 AND days_between_orders > 0.05)""",
    "category_month_series": f"""SELECT product_category, revenue_year, revenue_month_num, monthly_revenue, product_sold FROM monthly_revenue_by_cat
        WHERE product_category IN {SEL_CATS} AND revenue_year IN {SEL_YEARS} ORDER BY 1, 2, 3""",
    # windows
    "win_prev_order": "SELECT order_id, customer_unique_id, purchase_at, previous_order_at FROM customer_retention_facts",
    "win_order_sequence": "SELECT order_id, customer_unique_id, order_sequence FROM customer_retention_facts",
    "win_customer_orders": "SELECT order_id, customer_unique_id, total_customer_orders FROM customer_retention_facts",
    "win_category_mean": "SELECT product_id, category, cat_avg_total_cost FROM cost_features",
    "win_category_stddev": "SELECT product_id, category, cat_stddev_total_cost FROM cost_features",
    "win_category_freight": "SELECT product_id, category, cat_avg_freight_share FROM cost_features",
    "win_running_revenue": "SELECT product_id, category, product_revenue, cumulative_category_revenue FROM product_cost_decomposition",
    "win_total_revenue": "SELECT product_id, category, total_category_revenue FROM product_cost_decomposition",
    # sorts
    "sort_month": "SELECT * FROM monthly_revenue ORDER BY order_month DESC",
    "sort_year_month_revenue": "SELECT * FROM monthly_revenue_by_cat ORDER BY revenue_year DESC, revenue_month_num DESC, monthly_revenue DESC",
    # scalar functions
    "fn_cast_timestamp": "SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS ts_text, order_purchase_timestamp AS ts FROM raw_orders",
    "fn_month": "SELECT order_id, CAST(date_trunc('month', purchase_at) AS DATE) AS order_month FROM stg_order",
    "fn_numeric": "SELECT order_id, order_item_id, product_id, CAST(total_item_cost AS DECIMAL(20,4)) AS cost_numeric FROM stg_order_items",
    "fn_round": f"""SELECT product_id, {rnd('avg_price / CAST(3 AS DECIMAL(1,0))', 2)} AS third_price_2,
        {rnd('avg_total_cost / CAST(7 AS DECIMAL(1,0))', 4)} AS seventh_cost_4 FROM product_base_stats""",
    "fn_year_month": "SELECT order_id, CAST(year(purchase_at) AS BIGINT) AS y, CAST(month(purchase_at) AS BIGINT) AS m FROM stg_order",
    "fn_year_month_label": "SELECT order_id, strftime(purchase_at, '%Y-%m') AS year_month FROM stg_order",
    "fn_days_between": f"SELECT order_id, {rnd('(epoch_us(estimated_delivery_at) - epoch_us(purchase_at)) / 86400000000.0', 6)} AS days FROM stg_order",
    "fn_recency_days": f"SELECT order_id, {whole_days('(epoch_us(estimated_delivery_at) - epoch_us(purchase_at))')} AS elapsed_days FROM stg_order",
    "fn_coalesce": "SELECT order_id, coalesce(delivered_to_customer_at, delivered_to_carrier_at, estimated_delivery_at) AS first_known FROM stg_order",
    "fn_safe_divide": f"SELECT order_id, {rnd(sdiv('total_freight', 'total_price'), 6)} AS freight_ratio FROM fct_orders",
    "fn_volume": "SELECT product_id, volume_cm3 FROM dim_products",
    "fn_case_segment": "SELECT customer_unique_id, lifetime_value, customer_segment FROM dim_customer",
    "fn_fillna": "SELECT order_id, coalesce(days_between_orders, 0) AS days_between_orders FROM customer_retention",
    # marts
    "fct_orders": "SELECT * FROM fct_orders",
    "dim_products": "SELECT * FROM dim_products",
    "dim_customer": "SELECT * FROM dim_customer",
    "monthly_revenue": "SELECT * FROM monthly_revenue",
    "monthly_revenue_by_cat": "SELECT * FROM monthly_revenue_by_cat",
    "product_base_stats": "SELECT * FROM product_base_stats",
    "product_cost_decomposition": f"SELECT {_PCD_COLS} FROM product_cost_decomposition",
    "retention_facts": """SELECT customer_unique_id, order_id, purchase_at, previous_order_at, order_sequence, total_customer_orders,
        days_between_orders, recency_days FROM customer_retention_facts""",
    "customer_retention": "SELECT * FROM customer_retention",
    "event_retention": "SELECT * FROM event_retention",
    "customer_segments": "SELECT customer_segment, count(*) AS customers FROM dim_customer GROUP BY 1",
    "reliability_score": "SELECT product_id, sales_count, reliability_score FROM product_base_stats",
    "freight_share": "SELECT product_id, avg_freight, avg_total_cost, freight_share_pct FROM cost_features",
    "category_benchmarks": "SELECT * FROM category_benchmarks",
    "total_cost_z_score": "SELECT product_id, category, total_cost_z_score FROM cost_features",
    "price_rebalanced": "SELECT product_id, sales_count, is_price_rebalanced FROM cost_features",
    "freight_deviation": f"""SELECT f.product_id, f.freight_pct_diff_from_avg, {rnd('g.cat_avg_freight_share_pct', 9)} AS cat_avg_freight_share_pct,
        {rnd('f.freight_share_pct - g.cat_avg_freight_share_pct', 9)} AS freight_share_pct_diff
        FROM cost_features f LEFT JOIN (SELECT category, avg(freight_share_pct) AS cat_avg_freight_share_pct FROM cost_features GROUP BY 1) g USING (category)""",
    "cost_cv": "SELECT product_id, total_cost_cv FROM cost_features",
    "product_revenue": "SELECT product_id, avg_price, sales_count, product_revenue FROM cost_features",
    "pareto_products": """SELECT product_id, category, cumulative_category_revenue, total_category_revenue, product_revenue_share_pct,
        pareto_revenue_pct, is_revenue_workhorse FROM product_cost_decomposition""",
    "pareto_categories": f"""SELECT category, category_revenue, cumulative_revenue, total_revenue,
        {rnd(sdiv('category_revenue', 'total_revenue') + ' * 100.0', 4)} AS revenue_share_pct,
        {rnd(sdiv('cumulative_revenue', 'total_revenue') + ' * 100.0', 4)} AS pareto_revenue_pct,
        coalesce(CASE WHEN total_revenue <> 0 THEN cumulative_revenue * 5 <= total_revenue * 4 END, false) AS is_top_category
        FROM (SELECT category, category_revenue,
                     sum(category_revenue) OVER (ORDER BY category_revenue DESC NULLS FIRST) AS cumulative_revenue,
                     sum(category_revenue) OVER () AS total_revenue
              FROM (SELECT category, CAST(sum(product_revenue) AS DECIMAL(38,2)) AS category_revenue
                    FROM product_cost_decomposition GROUP BY 1))""",
    "lifecycle_stage": "SELECT order_id, order_sequence, total_customer_orders, recency_days, lifecycle_stage FROM customer_retention",
    "retention_window": "SELECT order_id, order_sequence, days_between_orders, retention_window FROM customer_retention",
    # analytics
    "anomaly_features": """SELECT product_id, coalesce(CAST(total_cost_z_score AS DOUBLE), 0.0) AS total_cost_z_score,
        coalesce(CAST(total_cost_cv AS DOUBLE), 0.0) AS total_cost_cv, coalesce(CAST(freight_share_pct AS DOUBLE), 0.0) AS freight_share_pct
        FROM product_cost_decomposition WHERE reliability_score <> 'Single Sale'""",
    "audit_workhorses": """SELECT product_id, category, is_revenue_workhorse, product_revenue_share_pct, avg_price, total_cost_z_score,
        sales_count, is_price_rebalanced FROM product_cost_decomposition WHERE is_revenue_workhorse
        ORDER BY product_revenue_share_pct DESC NULLS LAST, product_id""",
    "anomaly_split": "SELECT product_id, reliability_score <> 'Single Sale' AS is_analyzed FROM product_cost_decomposition",
    "anomaly_min_rows": "SELECT product_id, 'Single sale - No Analysis' AS Result FROM product_cost_decomposition",
    "kpi_items_analyzed": "SELECT count(*) AS items_analyzed FROM product_cost_decomposition WHERE reliability_score <> 'Single Sale'",
    "audit_columns": f"SELECT {_AUDIT_COLS} FROM product_cost_decomposition ORDER BY product_revenue_share_pct DESC NULLS LAST, product_id",
    "audit_only_anomalies": f"""SELECT {_AUDIT_COLS}, 'Anomaly' AS Result FROM product_cost_decomposition
        WHERE abs(total_cost_z_score) > 2.0 AND is_revenue_workhorse""",
    "flt_anomalies": "SELECT product_id, category, 'Anomaly' AS Result FROM product_cost_decomposition WHERE abs(total_cost_z_score) > 2.0",
    "outlier_map": """SELECT product_id, category, avg_price, avg_freight, sales_count,
        coalesce(CAST(total_cost_z_score AS DOUBLE), 0.0) AS total_cost_z_score,
        coalesce(CAST(total_cost_cv AS DOUBLE), 0.0) AS total_cost_cv,
        coalesce(CAST(freight_share_pct AS DOUBLE), 0.0) AS freight_share_pct
        FROM product_cost_decomposition WHERE reliability_score <> 'Single Sale'""",
    "cv_above_quantile": """SELECT product_id, total_cost_cv, total_cost_cv > (
            SELECT quantile_cont(total_cost_cv, 0.95) FROM product_cost_decomposition WHERE reliability_score <> 'Single Sale') AS is_above
        FROM product_cost_decomposition WHERE reliability_score <> 'Single Sale' AND total_cost_cv IS NOT NULL""",
    "fn_value_map": """SELECT order_id, CASE order_status WHEN 'delivered' THEN 'done' WHEN 'shipped' THEN 'open' WHEN 'canceled' THEN 'void' END AS state
        FROM stg_order""",
    "retention_split": "SELECT * FROM customer_retention",
    "pareto_split": """SELECT product_id, category, product_revenue, cumulative_category_revenue, total_category_revenue
        FROM product_cost_decomposition""",
    "z_outliers": "SELECT product_id, category, total_cost_z_score FROM product_cost_decomposition WHERE abs(total_cost_z_score) > 2.0",
    # data quality
    "dq_unique": "SELECT order_id, count(*) AS n_records FROM stg_order_items WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "dq_not_null": "SELECT order_id, order_sequence FROM customer_retention WHERE previous_order_at IS NULL",
    "dq_accepted_values": """SELECT order_status, count(*) AS n_records FROM stg_order
        WHERE order_status IS NOT NULL AND order_status NOT IN ('delivered', 'shipped', 'processing') GROUP BY 1""",
    "dq_accepted_range": "SELECT product_id, sales_count FROM product_base_stats WHERE sales_count IS NOT NULL AND sales_count < 4",
    "dq_expression": """SELECT order_id, days_between_orders FROM event_retention
        WHERE order_sequence > 1 AND NOT coalesce(days_between_orders > 0.05, true)""",
    "dq_same_count": "SELECT count(*) AS left_rows, count(*) AS right_rows, true AS same FROM product_cost_decomposition",
    "dq_report": _dq_report(),
}


# ---------------------------------------------------------------- isolation forest
def _forest(contamination: float = 0.05, trees: int = 100, psi: int = 256, seed: int = 42) -> str:
    """CTEs up to forest_labels(product_id, anomaly_score, is_anomaly): sample, eight levels, path lengths, cut."""
    prime, unit = 2_147_483_647, 4_294_967_296
    bits = lambda d, first, digits: f"CAST('0x' || substr({d}, {first}, {digits}) AS BIGINT)"
    # c(n) in units of 2**-32
    mean = lambda n: f"(CASE WHEN {n} > 1 THEN 2 * (SELECT sum({unit} // k) FROM range(1, 257) r(k) WHERE k < {n}) - 2 * ({n} - 1) * {unit} // {n} ELSE 0 END)"
    out = f""",
trained AS MATERIALIZED (
  SELECT product_id, [coalesce(CAST(total_cost_z_score AS DOUBLE), 0.0), coalesce(CAST(total_cost_cv AS DOUBLE), 0.0), coalesce(CAST(freight_share_pct AS DOUBLE), 0.0)] AS x
  FROM product_cost_decomposition WHERE reliability_score <> 'Single Sale'
),
forest AS (SELECT n, psi, CAST(ceil(log2(greatest(psi, 2))) AS INTEGER) AS height FROM (SELECT count(*) AS n, least({psi}, greatest(count(*), 1)) AS psi FROM trained)),
gates AS (
  SELECT least({unit}, 3 * {trees} * psi * {unit} // greatest(n, 1)) AS row_gate, least({prime}, 3 * psi * {prime} // greatest(least(n, 3 * {trees} * psi), 1)) AS tree_gate FROM forest
),
hashed AS (SELECT *, md5('row' || chr(1) || '{seed}' || chr(1) || CAST(product_id AS VARCHAR)) AS d FROM trained),
candidates AS (
  SELECT product_id, x, tree, ({bits('d', 1, 8)} % {prime} * (tree + 1) + {bits('d', 9, 8)} % {prime}) % {prime} AS h
  FROM hashed, range({trees}) t(tree), gates WHERE {bits('d', 17, 8)} < row_gate
),
picked AS (SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY h, product_id) AS r FROM candidates, gates WHERE h < tree_gate),
level0 AS MATERIALIZED (SELECT tree, x, CAST(1 AS BIGINT) AS node FROM picked, forest WHERE r <= psi),
level0_nodes AS (SELECT NULL::BIGINT AS tree, NULL::BIGINT AS node, NULL::INTEGER AS f, NULL::DOUBLE AS cut WHERE false)"""
    for d in range(8):
        out += f""",
ranges{d} AS (
  SELECT tree, node, [min(x[1]), min(x[2]), min(x[3])] AS lo, [max(x[1]), max(x[2]), max(x[3])] AS hi,
         md5('node' || chr(1) || '{seed}' || chr(1) || CAST(tree AS VARCHAR) || chr(1) || CAST(node AS VARCHAR)) AS d
  FROM level{d} GROUP BY tree, node
),
cuts{d} AS MATERIALIZED (
  SELECT tree, node, f, CASE WHEN raw >= hi[f] THEN lo[f] ELSE raw END AS cut
  FROM (SELECT *, lo[f] + {bits('d', 9, 12)}::DOUBLE / 281474976710656.0::DOUBLE * (hi[f] - lo[f]) AS raw
        FROM (SELECT *, wide[1 + {bits('d', 1, 8)} % len(wide)] AS f
              FROM (SELECT *, list_filter([1, 2, 3], lambda i: hi[i] > lo[i]) AS wide FROM ranges{d}, forest WHERE {d} < height) WHERE len(wide) > 0))
),
level{d + 1} AS MATERIALIZED (
  SELECT tree, x, CASE WHEN f IS NULL THEN node WHEN x[f] <= cut THEN node * 2 ELSE node * 2 + 1 END AS node FROM level{d} LEFT JOIN cuts{d} USING (tree, node)
)"""
    walked = f"SELECT product_id, x, tree, CAST(1 AS BIGINT) AS node FROM trained, range({trees}) t(tree)"
    for d in range(8):
        walked = f"SELECT product_id, x, tree, CASE WHEN f IS NULL THEN node WHEN x[f] <= cut THEN node * 2 ELSE node * 2 + 1 END AS node FROM ({walked}) LEFT JOIN cuts{d} USING (tree, node)"
    return out + f""",
leaves AS (SELECT tree, node, CAST(floor(log2(node)) AS BIGINT) * {unit} + {mean('size')} AS length FROM (SELECT tree, node, count(*) AS size FROM level8 GROUP BY tree, node)),
whole AS (SELECT sum({mean('size')}) AS c FROM (SELECT tree, count(*) AS size FROM level0 GROUP BY tree)),
forest_scores AS MATERIALIZED (
  SELECT product_id, floor(pow(2.0::DOUBLE, -(CAST(sum(length) AS DOUBLE) / CAST(greatest(any_value(c), 1) AS DOUBLE))) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS anomaly_score
  FROM ({walked}) JOIN leaves USING (tree, node), whole GROUP BY product_id
),
forest_labels AS (
  SELECT product_id, anomaly_score, -anomaly_score < (SELECT quantile_cont(-anomaly_score, {contamination}) FROM forest_scores) AS is_anomaly FROM forest_scores
),
labelled AS (
  SELECT p.*, CASE WHEN (SELECT n FROM forest) < 11 OR is_anomaly IS NULL THEN 'Single sale - No Analysis' WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS Result
  FROM product_cost_decomposition p LEFT JOIN forest_labels USING (product_id)
)"""


FOREST: dict[str, str] = {
    "anomaly_min_rows_bound": "SELECT product_id, Result AS at_bound, 'Single sale - No Analysis' AS below_bound FROM labelled",
    "isolation_forest": "SELECT product_id, anomaly_score, is_anomaly FROM forest_labels",
    "anomaly_labels": "SELECT * FROM labelled",
    "kpi_anomalies": f"""SELECT items_analyzed, anomalies, {rnd(sdiv('anomalies', 'items_analyzed') + ' * 100.0', 1)} AS anomaly_pct
        FROM (SELECT count(*) AS items_analyzed, count(*) FILTER (Result = 'Anomaly') AS anomalies FROM labelled WHERE reliability_score <> 'Single Sale')""",
    "audit_view": f"SELECT {_AUDIT_COLS}, Result FROM labelled",
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query key."""
    ctes = CTES.rstrip()
    forest = ctes + _forest()
    return {k: CTES + "\n" + v for k, v in FINAL.items()} | {k: forest + "\n" + v for k, v in FOREST.items()}
