"""DuckDB SQL for the correctness gate: the same results as ``plans.catalog``.

Each entry is self-contained SQL over the pre-registered test tables
(events, part, customer, nation). A shared WITH prelude rebuilds the adapter
(hits, sessions, purchases) relationally; every query then reads the whole
tables. Money is summed as integer micros (BIGINT) and divided at the end,
so floating-point results agree exactly with Spark.
"""

from __future__ import annotations

# Written out here and not taken from the library, so that a slip there shows.
# Action codes, SKU pattern, date window.
_CODE_CASE = "CASE e.event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 6 ELSE 0 END"
SKU_PATTERN = "([0-9]+)"
RANGE_FROM, RANGE_TO = "20240105", "20240111"


def _prelude(where: str = "") -> str:
    return f"""
WITH
ev AS (SELECT * FROM events e {where}),
raw_hits AS (
  SELECT concat(CAST(e.user_id AS VARCHAR), '-', strftime(CAST(e.ts AS DATE), '%Y%m%d')) AS session_id,
         'EVENT' AS hit_type,
         CAST({_CODE_CASE} AS INTEGER) AS eCommerceAction_action_type,
         CAST(TRY_CAST(NULLIF(regexp_extract(e.props, '{SKU_PATTERN}', 1), '') AS BIGINT) AS VARCHAR) AS productSKU,
         e.user_id, CAST(e.ts AS DATE) AS event_day, e.ts, e.event_id, e.value
  FROM ev e
),
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS productSKU, p_type AS v2ProductCategory, p_retailprice AS productPrice
  FROM part
),
hits AS (
  SELECT h.*, p.v2ProductCategory, COALESCE(p.productPrice, 0.0) AS productPrice
  FROM raw_hits h LEFT JOIN products p ON p.productSKU = h.productSKU
),
hits_seq AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_day ORDER BY ts, event_id) AS INTEGER) AS hitNumber
  FROM hits
),
rolled AS (
  SELECT user_id, event_day,
    CAST(count_if(eCommerceAction_action_type = 2) AS INTEGER) AS totals_pageviews,
    CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS totals_bounces,
    CAST(count(*) + 1 AS INTEGER) AS totals_hits,
    CAST(count_if(eCommerceAction_action_type = 6) AS INTEGER) AS totals_transactions,
    CAST(SUM(CASE WHEN eCommerceAction_action_type = 6 THEN CAST(ROUND(value * 1000000) AS BIGINT) END) AS BIGINT)
      AS totals_transactionRevenue,
    COALESCE(bool_or(eCommerceAction_action_type = 2), false) AS reached_product_view,
    COALESCE(bool_or(eCommerceAction_action_type = 3), false) AS reached_cart,
    COALESCE(bool_or(eCommerceAction_action_type = 5), false) AS reached_checkout
  FROM raw_hits GROUP BY user_id, event_day
),
raw_sessions AS (
  SELECT CAST(r.user_id AS VARCHAR) AS fullVisitorId,
    CAST(strftime(r.event_day, '%Y%m%d') AS BIGINT) AS visitId,
    concat(CAST(r.user_id AS VARCHAR), '-', strftime(r.event_day, '%Y%m%d')) AS session_id,
    strftime(r.event_day, '%Y%m%d') AS date,
    c.c_mktsegment AS channelGrouping,
    CASE WHEN r.user_id % 10 < 7 THEN 'desktop' WHEN r.user_id % 10 < 9 THEN 'mobile' ELSE 'tablet' END
      AS deviceCategory,
    n.n_name AS country,
    r.totals_pageviews, r.totals_bounces, r.totals_hits, r.totals_transactions, r.totals_transactionRevenue,
    r.reached_product_view, r.reached_cart, r.reached_checkout
  FROM rolled r
  LEFT JOIN customer c ON c.c_custkey = r.user_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
),
sessions AS (
  SELECT session_id, fullVisitorId, CAST(strptime(date, '%Y%m%d') AS DATE) AS date,
    channelGrouping AS channel, deviceCategory AS device, country,
    CAST(totals_pageviews AS INTEGER) AS pageviews,
    reached_product_view, reached_cart, reached_checkout,
    COALESCE(totals_transactions, 0) > 0 AS purchased,
    CAST(COALESCE(totals_transactionRevenue, 0) AS DOUBLE) / 1000000.0 AS revenue,
    CAST(totals_transactionRevenue AS BIGINT) AS revenue_micros
  FROM raw_sessions
),
sdims AS (
  SELECT session_id, channelGrouping AS channel, deviceCategory AS device,
         CAST(strptime(date, '%Y%m%d') AS DATE) AS date
  FROM raw_sessions
),
purchases AS (
  SELECT h.session_id, d.date, h.productSKU, h.v2ProductCategory AS category, d.channel, d.device,
         h.productPrice AS item_value
  FROM hits h LEFT JOIN sdims d ON d.session_id = h.session_id
  WHERE h.eCommerceAction_action_type = 6
),
events_clean AS (
  SELECT h.session_id, h.hitNumber,
    CASE h.eCommerceAction_action_type WHEN 2 THEN 'product_view' WHEN 3 THEN 'add_to_cart'
      WHEN 5 THEN 'checkout' WHEN 6 THEN 'purchase' END AS event_type,
    h.eCommerceAction_action_type, h.productSKU, h.v2ProductCategory, d.channel, d.device, d.date AS event_date
  FROM hits_seq h LEFT JOIN sdims d ON d.session_id = h.session_id
  WHERE h.eCommerceAction_action_type IN (2, 3, 5, 6)
),
flags AS (
  SELECT session_id, CAST(reached_product_view AS INTEGER) AS reached_product_view,
    CAST(reached_cart AS INTEGER) AS reached_cart, CAST(reached_checkout AS INTEGER) AS reached_checkout,
    CAST(purchased AS INTEGER) AS purchased, device, channel, date, revenue_micros
  FROM sessions
),
wide AS (
  SELECT count(*) AS c0,
    CAST(COALESCE(SUM(CAST(reached_product_view AS BIGINT)), 0) AS BIGINT) AS c1,
    CAST(COALESCE(SUM(CAST(reached_cart AS BIGINT)), 0) AS BIGINT) AS c2,
    CAST(COALESCE(SUM(CAST(reached_checkout AS BIGINT)), 0) AS BIGINT) AS c3,
    CAST(COALESCE(SUM(CAST(purchased AS BIGINT)), 0) AS BIGINT) AS c4
  FROM sessions
),
stage_rows AS (
  SELECT 'Sessions' AS stage, 0 AS stage_order, c0 AS count, c0 AS prev, c0 AS c0 FROM wide
  UNION ALL SELECT 'Product View', 1, c1, c0, c0 FROM wide
  UNION ALL SELECT 'Add to Cart', 2, c2, c1, c0 FROM wide
  UNION ALL SELECT 'Checkout', 3, c3, c2, c0 FROM wide
  UNION ALL SELECT 'Purchase', 4, c4, c3, c0 FROM wide
),
frame AS (
  SELECT stage, stage_order, count,
    CAST(count AS DOUBLE) / NULLIF(CAST(c0 AS DOUBLE), 0) AS pct_of_sessions,
    CASE WHEN stage_order = 0 THEN NULL ELSE CAST(count AS DOUBLE) / NULLIF(CAST(prev AS DOUBLE), 0) END
      AS step_conv
  FROM stage_rows
),
seg AS (
  SELECT CAST(count_if(device = 'desktop') AS BIGINT) AS n_a,
         CAST(count_if(device = 'desktop' AND purchased) AS BIGINT) AS x_a,
         CAST(count_if(device = 'mobile') AS BIGINT) AS n_b,
         CAST(count_if(device = 'mobile' AND purchased) AS BIGINT) AS x_b,
         CAST(count_if(purchased) AS BIGINT) AS buyers,
         SUM(CASE WHEN purchased THEN COALESCE(revenue_micros, 0) END) AS buyer_micros
  FROM sessions
),
rates AS (
  SELECT *, CAST(x_a AS DOUBLE) / NULLIF(CAST(n_a AS DOUBLE), 0) AS rate_a,
            CAST(x_b AS DOUBLE) / NULLIF(CAST(n_b AS DOUBLE), 0) AS rate_b,
            CAST(x_a + x_b AS DOUBLE) / NULLIF(CAST(n_a + n_b AS DOUBLE), 0) AS p_pool
  FROM seg
),
zt AS (
  SELECT *, sqrt(p_pool * (1.0 - p_pool) * (1.0 / NULLIF(CAST(n_a AS DOUBLE), 0) + 1.0 / NULLIF(CAST(n_b AS DOUBLE), 0)))
    AS se
  FROM rates
),
zz AS (SELECT *, (rate_a - rate_b) / NULLIF(se, 0.0) AS z FROM zt)
"""


def _p_value(z: str) -> str:
    """Two-sided p from z (NULL z gives NULL), to ten digits: Simpson's rule over the density beyond |z|,
    2 phi(z) times the integral of exp(-|z| t - t^2 / 2), t from 0 on. The library integrates nothing."""
    step = f"(0.001 / (1 + abs({z})))"
    terms = (f"list_transform(range(0, 40001), lambda i: (CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
             f"* exp(-abs({z}) * i * {step} - (i * {step}) * (i * {step}) / 2))")
    return (f"CASE WHEN {z} IS NOT NULL THEN CAST(printf('%.9e', 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) "
            f"* list_sum({terms}) * {step} / 3) AS DOUBLE) END")


_P_VALUE = _p_value("z")


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def _perf(keys: str) -> str:
    return f"""
SELECT {keys}, count(*) AS sessions,
  CAST(COALESCE(SUM(CAST(purchased AS BIGINT)), 0) AS BIGINT) AS orders,
  CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS revenue_micros
FROM sessions GROUP BY {keys}"""


def _label(n: str, d: str, decimals: int) -> str:
    scale = 10 ** decimals
    units = f"(({n}) * {200 * scale} + ({d})) // (2 * ({d}))"
    return (f"CASE WHEN ({d}) > 0 THEN concat(CAST(({units}) // {scale} AS VARCHAR), '.', "
            f"lpad(CAST(({units}) % {scale} AS VARCHAR), {decimals}, '0'), '%') END")


def _nested_flat() -> str:
    return "(SELECT session_id, channel, device, country, pageviews, CAST(reached_product_view AS INTEGER) AS " \
           "reached_product_view, CAST(reached_cart AS INTEGER) AS reached_cart, CAST(reached_checkout AS INTEGER) " \
           "AS reached_checkout, CAST(purchased AS INTEGER) AS purchased, revenue_micros FROM sessions)"


_RANGE_WHERE = (f"WHERE e.ts >= CAST(strptime('{RANGE_FROM}', '%Y%m%d') AS TIMESTAMP) AND "
                f"e.ts < CAST(strptime('{RANGE_TO}', '%Y%m%d') AS TIMESTAMP) + INTERVAL 1 DAY")

#: Orders as text that is not clean.
_TEXT_ROWS = """(
  SELECT CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS session_id,
    concat(CAST(year(o_orderdate) AS VARCHAR), lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0'), lpad(CAST(o_custkey % 33 AS VARCHAR), 2, '0')) AS date,
    CASE WHEN o_custkey % 7 = 0 THEN o_orderstatus ELSE o_orderpriority[1:1] END AS totals_pageviews
  FROM orders)"""

BODIES: dict[str, str] = {
    "quality_report": """
SELECT CAST(SUM(ns) AS BIGINT) AS sessions, CAST(SUM(nh) AS BIGINT) AS hits,
  CAST(COALESCE(SUM(GREATEST(ns - 1, 0)), 0) AS BIGINT) AS duplicate_session_ids,
  CAST(COALESCE(SUM(CASE WHEN nh = 0 THEN ns END), 0) AS BIGINT) AS sessions_without_hits
FROM (SELECT session_id, SUM(s) AS ns, SUM(h) AS nh FROM (
  SELECT session_id, 1 AS s, 0 AS h FROM raw_sessions UNION ALL SELECT session_id, 0, 1 FROM hits)
  GROUP BY session_id)""",
    "quality_report_customers": """
SELECT (SELECT count(*) FROM events) AS sessions, (SELECT count(*) FROM customer) AS hits,
  (SELECT count(*) - count(DISTINCT user_id) FROM events) AS duplicate_session_ids,
  (SELECT count(*) FROM events e WHERE NOT EXISTS (
     SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id)) AS sessions_without_hits""",
    "quality_report_orders": """
SELECT (SELECT count(*) FROM orders) AS sessions, (SELECT count(*) FROM events) AS hits,
  (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS duplicate_session_ids,
  (SELECT count(*) FROM orders o WHERE NOT EXISTS (
     SELECT 1 FROM events e WHERE e.user_id = o.o_custkey)) AS sessions_without_hits""",
    "rejected_cells": f"""
SELECT session_id, "column", value, reason FROM (
  SELECT session_id, 'session_id' AS "column", session_id AS value, 'missing' AS reason, session_id = '' AS bad FROM {_TEXT_ROWS}
  UNION ALL SELECT session_id, 'date', date, 'not a date yyyyMMdd', try_strptime(date, '%Y%m%d') IS NULL FROM {_TEXT_ROWS}
  UNION ALL SELECT session_id, 'totals_pageviews', totals_pageviews, 'not a int', TRY_CAST(totals_pageviews AS INTEGER) IS NULL FROM {_TEXT_ROWS}
) WHERE bad""",
    "typed_sessions": f"""
SELECT session_id, CAST(strptime(date, '%Y%m%d') AS DATE) AS date, CAST(totals_pageviews AS INTEGER) AS totals_pageviews FROM (
  SELECT * FROM {_TEXT_ROWS}
  WHERE session_id <> '' AND try_strptime(date, '%Y%m%d') IS NOT NULL AND TRY_CAST(totals_pageviews AS INTEGER) IS NOT NULL)""",
    "quality_report_dates": f"""
WITH rows AS (SELECT * FROM {_TEXT_ROWS})
SELECT (SELECT count(*) FROM rows) AS sessions, (SELECT count(*) FROM lineitem) AS hits,
  (SELECT count(*) - count(DISTINCT session_id) FROM rows) AS duplicate_session_ids,
  (SELECT count(*) FROM rows WHERE session_id NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)) AS sessions_without_hits,
  (SELECT count(*) FROM rows WHERE try_strptime(date, '%Y%m%d') IS NULL) AS bad_dates, CAST(0 AS BIGINT) AS missing_dates""",
    "stage_table_months": """
WITH months AS (SELECT DISTINCT month(l_shipdate) AS m FROM lineitem WHERE l_shipdate IS NOT NULL),
reached AS (
  SELECT DISTINCT o.o_orderkey, o.o_orderstatus, month(l.l_shipdate) AS m FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
), counts AS (
  SELECT o_orderstatus, 0 AS stage_order, 'Orders' AS stage, count(*) AS n FROM orders GROUP BY o_orderstatus
  UNION ALL
  SELECT s.o_orderstatus, months.m, concat('month ', CAST(months.m AS VARCHAR)), count(r.o_orderkey)
  FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN months
  LEFT JOIN reached r ON r.o_orderstatus = s.o_orderstatus AND r.m = months.m GROUP BY ALL
)
SELECT o_orderstatus, stage, CAST(stage_order AS INTEGER) AS stage_order, n AS count,
  CAST(n AS DOUBLE) / NULLIF(CAST(first_value(n) OVER w AS DOUBLE), 0) AS pct_of_sessions,
  CAST(n AS DOUBLE) / NULLIF(CAST(lag(n) OVER w AS DOUBLE), 0) AS step_conv
FROM counts WINDOW w AS (PARTITION BY o_orderstatus ORDER BY stage_order)""",
    "clean_sessions": "SELECT * FROM sessions",
    "clean_sessions_joined": "SELECT * FROM sessions",
    "customers_without_events": """
SELECT CAST(c_custkey AS VARCHAR) AS session_id, c_mktsegment, c_nationkey FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""",
    "duplicate_order_keys": """
SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_keys, count(*) - count(DISTINCT l_orderkey) AS duplicate_rows
FROM lineitem""",
    "purchase_lines": "SELECT * FROM purchases",
    "event_log": "SELECT * FROM events_clean",
    "nested_sessions": """
SELECT session_id, fullVisitorId, date, channel, device, country, pageviews, reached_product_view, reached_cart,
  reached_checkout, purchased, revenue, revenue_micros FROM sessions""",
    "pipeline_summary": f"""
SELECT (SELECT count(*) FROM sessions) AS sessions_rows, (SELECT count(*) FROM purchases) AS purchases_rows,
  (SELECT count(*) FROM events_clean) AS events_rows,
  (SELECT {_ratio('SUM(CAST(purchased AS BIGINT))', 'count(*)')} FROM sessions) AS overall_conversion,
  (SELECT CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1e6 FROM sessions) AS total_revenue""",
    "action_counts": """
SELECT eCommerceAction_action_type, count(*) AS hits FROM hits GROUP BY 1 ORDER BY 1""",
    "join_hits_sessions": """
SELECT h.event_id, h.session_id, h.eCommerceAction_action_type, h.productSKU, d.channel, d.device, d.date
FROM hits h LEFT JOIN sdims d ON d.session_id = h.session_id""",
    "sessions_without_hits": """
SELECT session_id, fullVisitorId, date, deviceCategory FROM raw_sessions s
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.session_id = s.session_id
                  AND h.eCommerceAction_action_type IN (2, 3, 5, 6))""",
    "hits_products": """
SELECT event_id, session_id, productSKU, v2ProductCategory, productPrice FROM hits""",
    "stage_sets": """
SELECT session_id, array_to_string(list_sort(list(DISTINCT CASE eCommerceAction_action_type WHEN 2 THEN 'product_view'
  WHEN 3 THEN 'add_to_cart' WHEN 5 THEN 'checkout' WHEN 6 THEN 'purchase' END)), ',') AS stages
FROM hits WHERE eCommerceAction_action_type IN (2, 3, 5, 6) GROUP BY session_id""",
    "session_totals": """
SELECT session_id,
  CAST(count_if(eCommerceAction_action_type = 2) AS INTEGER) AS totals_pageviews,
  CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS totals_bounces,
  CAST(count(*) + 1 AS INTEGER) AS totals_hits,
  CAST(count_if(eCommerceAction_action_type = 6) AS INTEGER) AS totals_transactions,
  CAST(SUM(CASE WHEN eCommerceAction_action_type = 6 THEN CAST(ROUND(value * 1000000) AS BIGINT) END) AS BIGINT)
    AS totals_transactionRevenue
FROM raw_hits GROUP BY session_id""",
    "hit_sequence": "SELECT session_id, event_id, hitNumber FROM hits_seq",
    "duplicate_sessions": """
SELECT CAST(SUM(n) AS BIGINT) AS rows, count(*) AS distinct_keys, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT session_id, count(*) AS n FROM raw_sessions GROUP BY session_id)""",
    "exists_flags": """
SELECT session_id, reached_product_view, reached_cart, reached_checkout FROM sessions""",
    "nested_funnel": f"""
SELECT count(*) AS sessions, CAST(SUM(reached_product_view) AS BIGINT) AS product_views,
  CAST(SUM(reached_cart) AS BIGINT) AS add_to_carts, CAST(SUM(reached_checkout) AS BIGINT) AS checkouts,
  CAST(SUM(purchased) AS BIGINT) AS purchases,
  ROUND({_ratio('SUM(reached_cart)', 'SUM(reached_product_view)')}, 4) AS view_to_cart,
  ROUND({_ratio('SUM(reached_checkout)', 'SUM(reached_cart)')}, 4) AS cart_to_checkout,
  ROUND({_ratio('SUM(purchased)', 'SUM(reached_checkout)')}, 4) AS checkout_to_purchase,
  ROUND({_ratio('SUM(purchased)', 'count(*)')}, 4) AS overall_conversion
FROM {_nested_flat()}""",
    "nested_device": f"""
SELECT device, count(*) AS sessions,
  ROUND({_ratio('SUM(reached_cart)', 'SUM(reached_product_view)')}, 4) AS view_to_cart,
  ROUND({_ratio('SUM(reached_checkout)', 'SUM(reached_cart)')}, 4) AS cart_to_checkout,
  ROUND({_ratio('SUM(purchased)', 'SUM(reached_checkout)')}, 4) AS checkout_to_purchase,
  ROUND({_ratio('SUM(purchased)', 'count(*)')}, 4) AS overall_conversion
FROM {_nested_flat()} GROUP BY device""",
    "nested_channel": f"""
SELECT channel, count(*) AS sessions, CAST(SUM(purchased) AS BIGINT) AS orders,
  ROUND({_ratio('SUM(purchased)', 'count(*)')}, 4) AS conversion_rate,
  ROUND(CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1e6, 2) AS revenue,
  ROUND(CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1e6 / count(*), 3) AS revenue_per_session
FROM {_nested_flat()} GROUP BY channel""",
    "nested_matrix": f"""
SELECT device, channel, count(*) AS sessions, ROUND({_ratio('SUM(purchased)', 'count(*)')}, 4) AS conversion_rate
FROM {_nested_flat()} GROUP BY device, channel""",
    "funnel_overall": "SELECT stage, stage_order, count, pct_of_sessions, step_conv FROM frame",
    "device_funnel": """
SELECT device, stage, count, stage_order,
  CAST(count AS DOUBLE) / NULLIF(CAST(first_value(count) OVER w AS DOUBLE), 0) AS pct_of_sessions,
  CAST(count AS DOUBLE) / NULLIF(CAST(lag(count) OVER w AS DOUBLE), 0) AS step_conv
FROM (
  SELECT device, 'Sessions' AS stage, count(*) AS count, 0 AS stage_order FROM flags GROUP BY device
  UNION ALL SELECT device, 'Product View', CAST(SUM(reached_product_view) AS BIGINT), 1 FROM flags GROUP BY device
  UNION ALL SELECT device, 'Add to Cart', CAST(SUM(reached_cart) AS BIGINT), 2 FROM flags GROUP BY device
  UNION ALL SELECT device, 'Checkout', CAST(SUM(reached_checkout) AS BIGINT), 3 FROM flags GROUP BY device
  UNION ALL SELECT device, 'Purchase', CAST(SUM(purchased) AS BIGINT), 4 FROM flags GROUP BY device)
WINDOW w AS (PARTITION BY device ORDER BY stage_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "funnel_stage": "SELECT stage, count AS sessions, stage_order FROM frame",
    "union_stages": """
SELECT 'Sessions' AS stage, count(*) AS cnt FROM flags
UNION ALL SELECT 'Product View', CAST(SUM(reached_product_view) AS BIGINT) FROM flags
UNION ALL SELECT 'Add to Cart', CAST(SUM(reached_cart) AS BIGINT) FROM flags
UNION ALL SELECT 'Checkout', CAST(SUM(reached_checkout) AS BIGINT) FROM flags
UNION ALL SELECT 'Purchase', CAST(SUM(purchased) AS BIGINT) FROM flags""",
    "step_conversion": f"""
SELECT ROUND({_ratio('SUM(reached_product_view)', 'count(*)')}, 4) AS session_to_view,
  ROUND({_ratio('SUM(reached_cart)', 'SUM(reached_product_view)')}, 4) AS view_to_cart,
  ROUND({_ratio('SUM(reached_checkout)', 'SUM(reached_cart)')}, 4) AS cart_to_checkout,
  ROUND({_ratio('SUM(purchased)', 'SUM(reached_checkout)')}, 4) AS checkout_to_purchase,
  ROUND({_ratio('SUM(purchased)', 'count(*)')}, 4) AS overall_conversion
FROM flags""",
    "device_rates": f"""
SELECT device, count(*) AS sessions,
  {_ratio('SUM(reached_cart)', 'SUM(reached_product_view)')} AS view_to_cart,
  {_ratio('SUM(reached_checkout)', 'SUM(reached_cart)')} AS cart_to_checkout,
  {_ratio('SUM(purchased)', 'SUM(reached_checkout)')} AS checkout_to_purchase,
  {_ratio('SUM(purchased)', 'count(*)')} AS overall_conversion
FROM flags GROUP BY device""",
    "device_rates_sql": f"""
SELECT device, count(*) AS sessions,
  ROUND({_ratio('SUM(reached_cart)', 'SUM(reached_product_view)')}, 4) AS view_to_cart,
  ROUND({_ratio('SUM(reached_checkout)', 'SUM(reached_cart)')}, 4) AS cart_to_checkout,
  ROUND({_ratio('SUM(purchased)', 'SUM(reached_checkout)')}, 4) AS checkout_to_purchase,
  ROUND({_ratio('SUM(purchased)', 'count(*)')}, 4) AS overall_conversion
FROM flags GROUP BY device""",
    "funnel_by_device": """
SELECT device, count(*) AS sessions, CAST(SUM(reached_product_view) AS BIGINT) AS product_view,
  CAST(SUM(reached_cart) AS BIGINT) AS cart, CAST(SUM(reached_checkout) AS BIGINT) AS checkout,
  CAST(SUM(purchased) AS BIGINT) AS purchase,
  CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1000000.0 AS revenue
FROM flags GROUP BY device""",
    "channel_performance": f"""
SELECT channel, sessions, orders, CAST(revenue_micros AS DOUBLE) / 1000000.0 AS revenue,
  {_ratio('orders', 'sessions')} AS conversion_rate,
  (CAST(revenue_micros AS DOUBLE) / 1000000.0) / NULLIF(CAST(sessions AS DOUBLE), 0) AS revenue_per_session
FROM ({_perf('channel')})""",
    "channel_performance_sql": f"""
SELECT channel, count(*) AS sessions, CAST(SUM(purchased) AS BIGINT) AS orders,
  ROUND({_ratio('SUM(purchased)', 'count(*)')}, 4) AS conversion_rate,
  ROUND(CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1e6, 2) AS revenue,
  ROUND(CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1e6 / count(*), 3) AS revenue_per_session
FROM flags GROUP BY channel""",
    "device_channel_matrix": f"""
SELECT device, channel, sessions, orders, {_ratio('orders', 'sessions')} AS conversion_rate
FROM ({_perf('device, channel')})""",
    "worst_pockets": f"""
SELECT device, channel, sessions, ROUND({_ratio('orders', 'sessions')}, 4) AS conversion_rate
FROM ({_perf('device, channel')})
ORDER BY {_ratio('orders', 'sessions')} ASC NULLS LAST, device ASC NULLS LAST, channel ASC NULLS LAST
LIMIT 10""",
    "daily_trend": f"""
SELECT date, sessions, orders, CAST(revenue_micros AS DOUBLE) / 1000000.0 AS revenue,
  {_ratio('orders', 'sessions')} AS conversion_rate
FROM ({_perf('date')})""",
    "daily_trend_by_device": f"""
SELECT date, device, sessions, orders, CAST(revenue_micros AS DOUBLE) / 1000000.0 AS revenue,
  {_ratio('orders', 'sessions')} AS conversion_rate
FROM ({_perf('date, device')})""",
    "daily_trend_head": f"""
SELECT date, count(*) AS sessions, CAST(SUM(purchased) AS BIGINT) AS orders,
  ROUND({_ratio('SUM(purchased)', 'count(*)')}, 4) AS conversion_rate,
  ROUND(CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1e6, 2) AS revenue
FROM flags GROUP BY date ORDER BY date ASC NULLS LAST LIMIT 15""",
    "category_revenue": f"""
SELECT category, orders, CAST(m AS DOUBLE) / 1000000.0 AS revenue,
  ({_ratio('m', 'n')}) / 1000000.0 AS avg_item_value
FROM (SELECT category, count(session_id) AS orders,
        CAST(COALESCE(SUM(CAST(ROUND(item_value * 1000000) AS BIGINT)), 0) AS BIGINT) AS m,
        count(item_value) AS n
      FROM purchases GROUP BY category)""",
    "category_revenue_sql": """
SELECT category, count(*) AS orders,
  ROUND(CAST(CAST(COALESCE(SUM(CAST(ROUND(item_value * 1000000) AS BIGINT)), 0) AS BIGINT) AS DOUBLE) / 1e6, 2)
    AS revenue,
  ROUND(CAST(CAST(SUM(CAST(ROUND(item_value * 1000000) AS BIGINT)) AS BIGINT) AS DOUBLE)
    / count(item_value) / 1e6, 2) AS avg_item_value
FROM purchases GROUP BY category""",
    "biggest_leak": """
SELECT stage, step_conv FROM frame WHERE step_conv IS NOT NULL ORDER BY step_conv, stage_order LIMIT 1""",
    "device_ztest": f"""
SELECT 'device' AS segment, 'desktop' AS group_a, 'mobile' AS group_b, n_a, x_a AS successes_a, n_b,
  x_b AS successes_b, rate_a, rate_b, p_pool, se, z, {_P_VALUE} AS p_value
FROM zz""",
    "gap_opportunity": """
SELECT 'desktop' AS segment_hi, 'mobile' AS segment_lo, aov, rate_a AS rate_hi, rate_b AS rate_lo, target_rate,
  extra_orders_period, extra_revenue_period, extra_revenue_period * 4.0 AS extra_revenue_annualized
FROM (SELECT *, (target_rate - rate_b) * n_b AS extra_orders_period,
             (target_rate - rate_b) * n_b * aov AS extra_revenue_period
      FROM (SELECT *, rate_b + 0.5 * (rate_a - rate_b) AS target_rate,
                   (CAST(buyer_micros AS DOUBLE) / NULLIF(CAST(buyers AS DOUBLE), 0)) / 1000000.0 AS aov
            FROM rates))""",
    "gap_ratio": """
SELECT 'desktop' AS group_a, 'mobile' AS group_b, rate_a, rate_b, rate_a / NULLIF(rate_b, 0.0) AS ratio FROM rates""",
    "aov": """
SELECT buyers AS orders, CAST(CAST(COALESCE(buyer_micros, 0) AS BIGINT) AS DOUBLE) / 1000000.0 AS revenue,
  (CAST(buyer_micros AS DOUBLE) / NULLIF(CAST(buyers AS DOUBLE), 0)) / 1000000.0 AS aov
FROM seg""",
    "kpi_measures": f"""
SELECT {_ratio('SUM(orders)', 'SUM(sessions)')} AS overall_conversion,
  CAST(CAST(SUM(revenue_micros) AS BIGINT) AS DOUBLE) / 1000000.0 AS total_revenue,
  CAST(SUM(orders) AS BIGINT) AS total_orders,
  (CAST(CAST(SUM(revenue_micros) AS BIGINT) AS DOUBLE) / 1000000.0) / NULLIF(CAST(SUM(orders) AS DOUBLE), 0) AS aov,
  CAST(SUM(sessions) AS BIGINT) AS total_sessions
FROM ({_perf('channel')})""",
    "totals": f"""
SELECT c0 AS total_sessions, c4 AS total_orders,
  (SELECT CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1000000.0 FROM sessions)
    AS total_revenue,
  {_ratio('c4', 'c0')} AS overall_conversion
FROM wide""",
    "funnel_labels": f"""
SELECT stage, stage_order, count,
  concat(format('{{:,}}', count), ' (', {_label('count', 'c0', 1)}, ')') AS label
FROM stage_rows""",
    "device_labels": f"""
SELECT device, count(*) AS sessions, CAST(SUM(purchased) AS BIGINT) AS orders,
  {_ratio('SUM(purchased)', 'count(*)')} AS overall_conversion,
  {_label('SUM(purchased)', 'count(*)', 2)} AS label
FROM flags GROUP BY device""",
    "metric_cube": """
SELECT CAST(grouping(device) * 4 + grouping(channel) * 2 + grouping(date) AS INTEGER) AS level,
  device, channel, date, count(*) AS sessions,
  CAST(SUM(reached_product_view) AS BIGINT) AS product_view, CAST(SUM(reached_cart) AS BIGINT) AS cart,
  CAST(SUM(reached_checkout) AS BIGINT) AS checkout, CAST(SUM(purchased) AS BIGINT) AS orders,
  CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1000000.0 AS revenue,
  CAST(SUM(purchased) AS DOUBLE) / NULLIF(CAST(count(*) AS DOUBLE), 0) AS conversion_rate
FROM flags
GROUP BY GROUPING SETS ((), (device), (channel), (device, channel), (date))""",
}

BODIES["findings_scalars"] = f"""
SELECT {_ratio('w.c4', 'w.c0')} AS overall_conversion, w.c0 AS total_sessions, w.c4 AS total_orders,
  (SELECT CAST(CAST(COALESCE(SUM(revenue_micros), 0) AS BIGINT) AS DOUBLE) / 1000000.0 FROM sessions) AS total_revenue,
  l.stage AS biggest_leak_stage, l.step_conv AS biggest_leak_step_conv,
  z.rate_a AS desktop_rate, z.rate_b AS mobile_rate, z.z AS z, {_p_value('z.z')} AS p_value,
  (CAST(z.buyer_micros AS DOUBLE) / NULLIF(CAST(z.buyers AS DOUBLE), 0)) / 1000000.0 AS aov,
  ((z.rate_b + 0.5 * (z.rate_a - z.rate_b)) - z.rate_b) * z.n_b AS recovery_extra_orders_period,
  ((z.rate_b + 0.5 * (z.rate_a - z.rate_b)) - z.rate_b) * z.n_b
    * ((CAST(z.buyer_micros AS DOUBLE) / NULLIF(CAST(z.buyers AS DOUBLE), 0)) / 1000000.0)
    AS recovery_extra_revenue_period,
  ((z.rate_b + 0.5 * (z.rate_a - z.rate_b)) - z.rate_b) * z.n_b
    * ((CAST(z.buyer_micros AS DOUBLE) / NULLIF(CAST(z.buyers AS DOUBLE), 0)) / 1000000.0) * 4.0
    AS recovery_extra_revenue_annualized
FROM wide w, zz z,
  (SELECT stage, step_conv FROM frame WHERE step_conv IS NOT NULL ORDER BY step_conv, stage_order LIMIT 1) l"""
BODIES["worst_pockets_sql"] = BODIES["worst_pockets"]
BODIES["nested_daily"] = BODIES["daily_trend"]
BODIES["nested_cube"] = BODIES["metric_cube"]
BODIES["device_rates_ranked"] = f"""
SELECT *, CAST(row_number() OVER (ORDER BY overall_conversion DESC NULLS LAST, device ASC NULLS LAST) AS INTEGER) AS place
FROM ({BODIES['device_rates']})"""
BODIES["funnel_by_device_ranked"] = f"""
SELECT *, CAST(row_number() OVER (ORDER BY device ASC NULLS LAST) AS INTEGER) AS place FROM ({BODIES['funnel_by_device']})"""


def _values(section: str, source: str, position: str, name: str, measures: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST({position} AS INTEGER) AS position, {name} AS name, '{m}' AS measure, "
        f"CAST({e} AS DOUBLE) AS value FROM ({source})" for m, e in measures.items())


_BY_DEVICE = f"SELECT *, row_number() OVER (ORDER BY overall_conversion DESC NULLS LAST, device DESC NULLS LAST) AS n " \
             f"FROM ({BODIES['device_rates']})"
_BY_CHANNEL = f"SELECT *, row_number() OVER (ORDER BY conversion_rate DESC NULLS LAST, channel DESC NULLS LAST) AS n " \
              f"FROM ({BODIES['channel_performance']})"
BODIES["findings_rows"] = " UNION ALL ".join([
    _values("overall_funnel", "SELECT * FROM frame", "stage_order + 1", "stage",
            {"count": "count", "pct_of_sessions": "pct_of_sessions", "step_conv": "step_conv"}),
    _values("by_device", _BY_DEVICE, "n", "device",
            {c: c for c in ("sessions", "view_to_cart", "cart_to_checkout", "checkout_to_purchase")}
            | {"overall_conv": "overall_conversion"}),
    _values("by_channel", _BY_CHANNEL, "n", "channel",
            {"sessions": "sessions", "conv": "conversion_rate", "revenue": "revenue",
             "rev_per_session": "revenue_per_session"}),
])
# Same daily trend over a pushed-down date range.
BODIES["date_range_scan"] = BODIES["daily_trend"]
BODIES["raw_csv"] = """
SELECT fullVisitorId, visitId, session_id, date, channelGrouping, deviceCategory, country, totals_pageviews, totals_bounces,
  totals_hits, totals_transactions, totals_transactionRevenue FROM raw_sessions"""
BODIES["processed_csv"] = "SELECT * REPLACE (NULLIF(revenue_micros, 0) AS revenue_micros) FROM sessions"
BODIES["json_document"] = BODIES["quality_report"]
BODIES["interleaved_layout"] = """
SELECT 'device' AS filter, device AS value, count(*) AS sessions, CAST(count_if(purchased) AS BIGINT) AS orders FROM sessions
WHERE device = 'mobile' GROUP BY device
UNION ALL
SELECT 'channel', channel, count(*), CAST(count_if(purchased) AS BIGINT) FROM sessions WHERE channel = 'BUILDING' GROUP BY channel"""
_ORDERS, _REVENUE = "CAST(count_if(purchased) AS BIGINT)", "CAST(COALESCE(SUM(revenue_micros), 0) AS DOUBLE) / 1000000"
BODIES["published_extracts"] = f"""
SELECT 'funnel_stage' AS extract, stage AS key, CAST(count AS BIGINT) AS sessions, CAST(NULL AS BIGINT) AS orders,
  CAST(NULL AS DOUBLE) AS revenue FROM frame
UNION ALL SELECT 'funnel_by_device', COALESCE(device, ''), count(*), {_ORDERS}, {_REVENUE} FROM sessions GROUP BY device
UNION ALL SELECT 'channel_performance', COALESCE(channel, ''), count(*), {_ORDERS}, {_REVENUE} FROM sessions GROUP BY channel
UNION ALL SELECT 'device_channel_matrix', concat(COALESCE(device, ''), '|', COALESCE(channel, '')), count(*), {_ORDERS}, NULL
  FROM sessions GROUP BY device, channel
UNION ALL SELECT 'daily_trend', CAST(date AS VARCHAR), count(*), {_ORDERS}, {_REVENUE} FROM sessions GROUP BY date
UNION ALL SELECT 'category_revenue', COALESCE(category, ''), NULL, count(session_id),
  CAST(COALESCE(SUM(CAST(ROUND(item_value * 1000000) AS BIGINT)), 0) AS DOUBLE) / 1000000 FROM purchases GROUP BY category"""
BODIES["daily_state_extracts"] = BODIES["published_extracts"]
BODIES["clamped_steps"] = """
SELECT device, stage, CASE WHEN step_conv IS NOT NULL THEN least(greatest(step_conv, 0.0), 1.0) END AS step_conv
FROM (""" + BODIES["device_funnel"] + ")"
BODIES["day_tables"] = BODIES["nested_sessions"]
BODIES["stage_table_funnel"] = BODIES["funnel_overall"]
BODIES["category_revenue_orders"] = f"""
SELECT category, orders, CAST(m AS DOUBLE) / 1000000.0 AS revenue,
  ({_ratio('m', 'n')}) / 1000000.0 AS avg_item_value
FROM (SELECT p.p_type AS category, count(l.l_orderkey) AS orders,
        CAST(COALESCE(SUM(CAST(ROUND(COALESCE(p.p_retailprice, 0.0) * 1000000) AS BIGINT)), 0) AS BIGINT) AS m,
        count(*) AS n
      FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY p.p_type)"""
# Category revenue from purchase lines and from per-SKU pre-aggregation agree.
BODIES["category_revenue_lines"] = BODIES["category_revenue"]
_RANGED = {"date_range_scan", "day_tables"}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        prelude = "" if body.lstrip().startswith("WITH") else _prelude(_RANGE_WHERE if name in _RANGED else "")
        out[name] = prelude + body
    return out
