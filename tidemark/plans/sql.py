"""The queries in plain SQL, as common table expressions that build on each other."""

from __future__ import annotations

from tidemark.operators.evidence import CRITERIA
from tidemark.operators.quality import CATALOG, CLICKSTREAM

EVENTS = """
ev0 AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
  date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
ev AS (SELECT event_id, ts AS event_time,
  CASE event_type WHEN 'click' THEN 'cart' WHEN 'error' THEN 'remove_from_cart' WHEN 'signup' THEN 'view' ELSE event_type END AS event_type,
  CAST(k AS VARCHAR) AS product_id, CAST(k % 10 AS VARCHAR) AS category_id,
  CASE WHEN k % 10 = 0 THEN 'cat.0' END AS category_code,
  CASE WHEN event_id % 5 >= 2 THEN 'b' || CAST(k % 7 AS VARCHAR) END AS brand,
  CAST(1000 + 300 * ((day // 3 + k) % 3) + event_id % 2 AS DOUBLE) / 100.0::DOUBLE AS price,
  CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 3 AS VARCHAR) END AS user_session
  FROM ev0)"""
DEDUPED = f"""{EVENTS},
raw AS (SELECT *, TIMESTAMP '2024-02-02' AS ingested_at, 'b.json' AS src_file FROM ev
  UNION ALL SELECT * REPLACE (price + 0.5::DOUBLE AS price),
    CASE WHEN event_id % 14 = 0 THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '2024-02-01' END, 'b.json' FROM ev WHERE event_id % 7 = 0),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_time, user_id, product_id, event_type
    ORDER BY ingested_at DESC, src_file DESC, price NULLS LAST, category_id NULLS LAST, category_code NULLS LAST, brand NULLS LAST, user_session NULLS LAST) AS rn
  FROM raw WHERE event_time IS NOT NULL AND user_id IS NOT NULL AND product_id IS NOT NULL) WHERE rn = 1)"""
SESSIONS = f"""{DEDUPED},
g AS (SELECT *, CAST(floor(epoch(event_time)) - floor(epoch(lag(event_time) OVER w)) AS BIGINT) AS gap_s FROM dd
  WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_type, product_id)),
s0 AS (SELECT *, CAST(sum(CASE WHEN gap_s <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_time, event_type, product_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM g),
s AS (SELECT *, user_id || '#' || CAST(session_seq AS VARCHAR) AS session_key FROM s0)"""


def intervals(source: str, name: str) -> str:
    """CTEs of the price intervals of (product_id, event_time, price_cents) rows."""
    return f"""
{name}1 AS (SELECT *, lag(price_cents) OVER (PARTITION BY product_id ORDER BY event_time, price_cents) AS was FROM {source}),
{name}2 AS (SELECT *, sum(CASE WHEN abs(price_cents - was) <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY product_id ORDER BY event_time, price_cents ROWS UNBOUNDED PRECEDING) AS run FROM {name}1),
{name}3 AS (SELECT product_id, run, min(event_time) AS effective_start, arg_min(price_cents, (event_time, price_cents)) AS cents FROM {name}2 GROUP BY product_id, run),
{name}4 AS (SELECT *, lead(effective_start) OVER (PARTITION BY product_id ORDER BY effective_start, run) AS effective_end FROM {name}3),
{name}5 AS (SELECT *, lag(cents) OVER (PARTITION BY product_id ORDER BY effective_start, run) AS before FROM {name}4 WHERE effective_end IS NULL OR effective_end > effective_start),
{name} AS (SELECT product_id, CAST(CAST(cents AS DECIMAL(14,2)) * 0.01 AS DECIMAL(12,2)) AS price, effective_start, effective_end,
  CASE WHEN before IS NULL THEN 'initial' WHEN cents > before THEN 'increase' WHEN cents < before THEN 'decrease' ELSE 'no_net_change' END AS change_reason,
  CAST(cents - before AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0) AS pct_change FROM {name}5)"""


PRICED = f"""{SESSIONS},
priced AS (SELECT product_id, event_time, CAST(round(price * 100) AS BIGINT) AS price_cents FROM dd WHERE price > 0)"""
INTERVALS = f"{PRICED},{intervals('priced', 'iv')}"
CLOSED = f"""{INTERVALS},
ci AS (SELECT *, coalesce(effective_end, (SELECT max(event_time) FROM dd) + INTERVAL 1 DAY) AS effective_until FROM iv)"""
BOUND = f"""{CLOSED},
b AS (SELECT s.*, ci.price AS catalog_price FROM s LEFT JOIN ci ON s.product_id = ci.product_id AND s.event_time >= ci.effective_start AND s.event_time < ci.effective_until),
sv AS (SELECT event_time, event_type, product_id, category_id, category_code, brand, CAST(price AS DECIMAL(12,2)) AS price_at_event, CAST(catalog_price AS DECIMAL(12,2)) AS catalog_price,
  CAST(price AS DECIMAL(12,2)) = CAST(catalog_price AS DECIMAL(12,2)) AS price_match, user_id, session_key FROM b)"""


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) ELSE 0.0::DOUBLE END"


def _ratio(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"


def _count(kind: str) -> str:
    return f"CAST(count(*) FILTER (event_type = '{kind}') AS BIGINT)"


FUNNEL = f"""{BOUND},
f0 AS (SELECT product_id, date_trunc('hour', event_time) AS event_hour, catalog_price, max(category_id) AS category_id, max(category_code) AS category_code,
  {_count('view')} AS views, {_count('cart')} AS carts, {_count('purchase')} AS purchases,
  CAST(coalesce(sum(price_at_event) FILTER (event_type = 'purchase'), 0) AS DECIMAL(18,2)) AS revenue
  FROM sv GROUP BY product_id, date_trunc('hour', event_time), catalog_price),
f AS (SELECT *, {_rate('carts', 'views')} AS view_to_cart, {_rate('purchases', 'carts')} AS cart_to_purchase, {_rate('purchases', 'views')} AS overall_conv FROM f0)"""
CHANGES = f"""{BOUND},
ch0 AS (SELECT *, lag(price) OVER w AS original_price, lag(effective_start) OVER w AS original_since FROM iv WINDOW w AS (PARTITION BY product_id ORDER BY effective_start)),
ch AS (SELECT product_id, effective_start AS changed_at, effective_end, original_since, original_price, price AS new_price, {_ratio('(price - original_price)', 'original_price')} AS pct_price_change FROM ch0
  WHERE abs({_ratio('(price - original_price)', 'original_price')}) > 0.15)"""
_BASE, _POST = "(c.event_time >= w.base AND c.event_time < w.changed_at)", "(c.event_time >= w.changed_at AND c.event_time < w.post)"
_HOURS = "(floor(epoch({1})) - floor(epoch({0}))) / 3600"
ELASTICITY = f"""{CHANGES},
w0 AS (SELECT ch.*, greatest(original_since, changed_at - INTERVAL 7 DAY) AS base, least(changed_at + INTERVAL 2 HOUR, effective_end, (SELECT max(event_time) FROM sv)) AS post FROM ch),
w AS (SELECT *, {_HOURS.format('base', 'changed_at')} AS base_hours, {_HOURS.format('changed_at', 'post')} AS post_hours FROM w0 WHERE {_HOURS.format('changed_at', 'post')} >= 1.0),
e0 AS (SELECT w.product_id, w.changed_at, w.original_price, w.new_price, w.pct_price_change, w.base_hours, w.post_hours,
  max(c.category_id) AS category_id, max(c.category_code) AS category_code,
  CAST(count(*) FILTER ({_BASE} AND c.event_type = 'view') AS BIGINT) AS base_views, CAST(count(*) FILTER ({_BASE} AND c.event_type = 'purchase') AS BIGINT) AS base_purchases,
  CAST(count(*) FILTER ({_POST} AND c.event_type = 'view') AS BIGINT) AS post_views, CAST(count(*) FILTER ({_POST} AND c.event_type = 'purchase') AS BIGINT) AS post_purchases
  FROM w LEFT JOIN sv c ON c.product_id = w.product_id AND ({_BASE} OR {_POST}) GROUP BY ALL),
e1 AS (SELECT *, CAST(base_purchases AS DOUBLE) / nullif(base_hours / 2.0::DOUBLE, 0) AS base_purchases_per_2h, CAST(post_purchases AS DOUBLE) / nullif(post_hours / 2.0::DOUBLE, 0) AS post_purchases_per_2h,
  {_rate('base_purchases', 'base_views')} AS base_conv, {_rate('post_purchases', 'post_views')} AS post_conv FROM e0),
e2 AS (SELECT *, (post_purchases_per_2h - base_purchases_per_2h) / nullif(base_purchases_per_2h, 0) AS pct_change_purchases FROM e1),
e AS (SELECT *, pct_change_purchases / nullif(pct_price_change, 0) AS elasticity FROM e2)"""
CARTS = f"""{CHANGES},
ca AS (SELECT c.product_id, c.category_id, c.category_code, c.session_key, c.event_time AS carted_at, i.changed_at, c.catalog_price AS price_at_cart, i.original_price AS price_before_increase, i.pct_price_change
  FROM sv c JOIN ch i ON c.product_id = i.product_id AND c.event_time >= i.changed_at AND c.event_time < i.changed_at + INTERVAL 30 MINUTE WHERE c.event_type = 'cart' AND i.pct_price_change > 0),
ab AS (SELECT *, CAST(price_at_cart AS DECIMAL(12,2)) AS lost_revenue_at_cart, CAST(price_before_increase AS DECIMAL(12,2)) AS lost_revenue_at_old FROM ca
  WHERE NOT EXISTS (SELECT 1 FROM sv p WHERE p.event_type = 'purchase' AND p.session_key = ca.session_key AND p.product_id = ca.product_id))"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def expectations(source: str, dataset: str, rules: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, '{name}' AS rule, '{action}' AS action, CAST(count(*) FILTER ({test}) AS BIGINT) AS passed, CAST(count(*) - count(*) FILTER ({test}) AS BIGINT) AS failed FROM {source}"
        for name, (test, action) in rules.items()
    )


SILVER = "event_time, event_type, product_id, category_id, category_code, brand, price_at_event, catalog_price, price_match, user_id, session_key"
FUNNEL_COLUMNS = "product_id, event_hour, catalog_price, category_id, category_code, views, carts, purchases, revenue, view_to_cart, cart_to_purchase, overall_conv"
_BATCH = "time_bucket(INTERVAL 5 MINUTE, event_time, TIMESTAMP '2000-01-01')"
_CATEGORY_DAILY = f"""SELECT category_id, CAST(date_trunc('day', event_hour) AS TIMESTAMP) AS business_date, max(category_code) AS category_code, count(*) AS product_hours,
  CAST(sum(views) AS BIGINT) AS views, CAST(sum(carts) AS BIGINT) AS carts, CAST(sum(purchases) AS BIGINT) AS purchases, CAST(sum(revenue) AS DECIMAL(18,2)) AS revenue,
  {_ratio('sum(carts)', 'sum(views)')} AS view_to_cart, {_ratio('sum(purchases)', 'sum(carts)')} AS cart_to_purchase, {_ratio('sum(revenue)', 'sum(purchases)')} AS revenue_per_purchase
  FROM f GROUP BY category_id, date_trunc('day', event_hour)"""
_MATCH_PERCENT = "round(100 * CAST({0} AS DOUBLE) / nullif(CAST(clicks - unpriced AS DOUBLE), 0), 3)"
_SHARE = """SELECT category_id, n, round(100 * (CAST(n AS DOUBLE) / CAST((SELECT sum(n) FROM t) AS DOUBLE)), 2) AS share_pct FROM t ORDER BY n DESC, category_id NULLS FIRST LIMIT 1"""
_AUDIT_ROWS = "count(*) AS n_rows, CAST(coalesce(sum(purchases), 0) AS BIGINT) AS purchases, CAST(CAST(coalesce(sum(revenue), 0) AS DECIMAL(18,2)) AS VARCHAR) AS revenue"
_TOP = "(SELECT category_id FROM f GROUP BY category_id ORDER BY sum(purchases) DESC, category_id NULLS FIRST LIMIT 1)"
_NULL_PCT = ", ".join(f"round(100 * (CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE)), 2) AS {c}_null_pct" for c in ("category_code", "brand", "user_session", "product_id"))
_VERSIONS = f"""{INTERVALS},
versions AS (SELECT *, TIMESTAMP '2024-03-02' AS ingested_at, 'v2' AS src_file FROM iv UNION ALL
  SELECT product_id, price + 1, effective_start, effective_end, change_reason, pct_change, TIMESTAMP '2024-03-01', 'v1' FROM iv UNION ALL
  SELECT product_id, price, effective_start, effective_start, change_reason, pct_change, TIMESTAMP '2024-03-02', 'v2' FROM iv WHERE change_reason = 'increase')"""
_LINES = """pp AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_shipdate AS TIMESTAMP) AS event_time,
  CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS price_cents FROM lineitem)"""
INTERVAL_COLUMNS = "product_id, price, effective_start, effective_end, change_reason, pct_change"

ORACLES = {
    "replay_window": with_(EVENTS, "SELECT event_id, event_time, event_type, product_id, price FROM ev WHERE event_time < (SELECT min(event_time) FROM ev) + INTERVAL 14 DAY"),
    "micro_batches": with_(EVENTS, f"SELECT strftime({_BATCH}, '%Y-%m-%d') AS dt, strftime({_BATCH}, '%H') AS hh, strftime({_BATCH}, '%M') AS min5, count(*) AS n FROM ev GROUP BY ALL"),
    "priced_events": with_(PRICED, "SELECT product_id, event_time, price_cents FROM priced"),
    "dedup": with_(DEDUPED, "SELECT event_id, event_time, user_id, product_id, event_type, price FROM dd"),
    "sessionize": with_(SESSIONS, "SELECT event_id, user_id, event_time, gap_s, session_seq, session_key FROM s"),
    "session_stats": with_(SESSIONS, """, n AS (SELECT session_key, count(*) AS n FROM s GROUP BY session_key) SELECT count(*) AS sessions, CAST(quantile_disc(n, 0.5) AS BIGINT) AS median_events,
  round(CAST(sum(n) AS DOUBLE) / CAST(count(*) AS DOUBLE), 2) AS mean_events, max(n) AS max_events FROM n"""),
    "session_disagreement": with_(SESSIONS, """, a AS (SELECT count(*) AS raw_split FROM (SELECT user_session FROM s WHERE user_session IS NOT NULL GROUP BY user_session HAVING count(DISTINCT session_key) > 1)),
  m AS (SELECT count(*) AS own_merged FROM (SELECT session_key FROM s WHERE user_session IS NOT NULL GROUP BY session_key HAVING count(DISTINCT user_session) > 1)),
  t AS (SELECT count(DISTINCT session_key) AS sessions FROM s)
SELECT raw_split, own_merged, sessions, round(100 * (CAST(own_merged AS DOUBLE) / nullif(CAST(sessions AS DOUBLE), 0)), 2) AS merged_pct FROM a, m, t"""),
    "most_split_session": with_(SESSIONS, """SELECT event_time, gap_s, event_type, product_id, session_key FROM s WHERE user_session =
  (SELECT user_session FROM s WHERE user_session IS NOT NULL GROUP BY user_session ORDER BY count(DISTINCT session_key) DESC, user_session LIMIT 1)"""),
    "events_per_user": with_(DEDUPED, "SELECT max(n) AS most, CAST(quantile_disc(n, 0.5) AS BIGINT) AS median FROM (SELECT count(*) AS n FROM dd GROUP BY user_id)"),
    "price_intervals": with_(INTERVALS, f"SELECT {INTERVAL_COLUMNS} FROM iv"),
    "tie_intervals_lineitem": with_(f"{_LINES},{intervals('pp', 'li')}", f"SELECT {INTERVAL_COLUMNS} FROM li"),
    "interval_reasons": with_(INTERVALS, "SELECT change_reason, count(*) AS intervals, count(DISTINCT product_id) AS products, CAST(count(*) FILTER (effective_end IS NULL) AS BIGINT) AS open_ended FROM iv GROUP BY change_reason"),
    "changed_products": with_(INTERVALS, "SELECT count(DISTINCT product_id) AS products FROM iv WHERE abs(pct_change) > 0.15"),
    "latest_intervals": with_(_VERSIONS, f"SELECT {INTERVAL_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY product_id, effective_start ORDER BY ingested_at DESC, src_file DESC, effective_end DESC NULLS FIRST, price DESC) AS rn FROM versions) WHERE rn = 1"),
    "closed_intervals": with_(CLOSED, "SELECT product_id, effective_start, effective_until FROM ci"),
    **{f"bind_{how}": with_(BOUND, f"SELECT {SILVER} FROM sv") for how in ("broadcast", "binned", "asof", "chosen")},
    "bind_agreement": with_(BOUND, "SELECT pair, (SELECT count(*) FROM sv) AS clicks, CAST(0 AS BIGINT) AS disagreements FROM (VALUES ('broadcast-binned'), ('broadcast-asof')) t(pair)"),
    "price_match_accuracy": with_(BOUND, f""", m AS (SELECT count(*) AS clicks, CAST(count(*) FILTER (catalog_price IS NULL) AS BIGINT) AS unpriced, CAST(count(*) FILTER (price_match) AS BIGINT) AS exact,
  CAST(count(*) FILTER (abs(price_at_event - catalog_price) <= 0.01) AS BIGINT) AS near FROM sv) SELECT *, {_MATCH_PERCENT.format('exact')} AS exact_pct, {_MATCH_PERCENT.format('near')} AS near_pct FROM m"""),
    "funnel_hourly": with_(FUNNEL, f"SELECT {FUNNEL_COLUMNS} FROM f"),
    "funnel_totals": with_(FUNNEL, "SELECT count(*) AS product_hours, CAST(sum(views) AS BIGINT) AS views, CAST(sum(carts) AS BIGINT) AS carts, CAST(sum(purchases) AS BIGINT) AS purchases, CAST(sum(revenue) AS DECIMAL(18,2)) AS revenue, CAST(count(*) FILTER (view_to_cart IS NULL OR cart_to_purchase IS NULL OR overall_conv IS NULL) AS BIGINT) AS null_rates FROM f"),
    "category_daily": with_(FUNNEL, _CATEGORY_DAILY),
    "salted_rollup": with_(FUNNEL, "SELECT category_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(purchases) AS BIGINT) AS purchases FROM f GROUP BY category_id"),
    "category_share": with_(FUNNEL, f", t AS (SELECT category_id, CAST(sum(views) AS BIGINT) AS n FROM f GROUP BY category_id) {_SHARE}"),
    "significant_changes": with_(CHANGES, "SELECT * FROM ch"),
    "change_counts": with_(CHANGES, "SELECT count(*) AS changes, count(DISTINCT product_id) AS products, CAST(count(*) FILTER (pct_price_change < 0) AS BIGINT) AS drops, CAST(count(*) FILTER (pct_price_change > 0) AS BIGINT) AS increases FROM ch"),
    "q1_elasticity": with_(ELASTICITY, "SELECT * FROM e"),
    "q1_floor_stats": with_(ELASTICITY, """SELECT CAST(floor AS INTEGER) AS floor, count(*) AS drops, count(DISTINCT product_id) AS products, quantile_disc(elasticity, 0.5) AS median_elasticity,
  CAST(count(*) FILTER (elasticity < 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS negative_share, CAST(count(*) FILTER (post_purchases = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS empty_post_share
  FROM e, (VALUES (1), (5), (10), (30)) fl(floor) WHERE pct_price_change < -0.15 AND elasticity IS NOT NULL AND base_purchases >= floor GROUP BY floor"""),
    "q1_report": with_(ELASTICITY, """SELECT product_id, changed_at, original_price, new_price, round(pct_price_change * 100, 1) AS price_change_pct, base_purchases, post_purchases, round(elasticity, 3) AS elasticity
  FROM e WHERE pct_price_change < -0.15 AND elasticity IS NOT NULL AND base_purchases >= 1 ORDER BY e.elasticity, product_id, changed_at LIMIT 50"""),
    "carts_after_increase": with_(CARTS, "SELECT * FROM ca"),
    "latest_increase": with_(CARTS, "SELECT product_id, category_id, category_code, session_key, carted_at, price_at_cart, max(changed_at) AS changed_at, arg_max(price_before_increase, changed_at) AS price_before_increase, arg_max(pct_price_change, changed_at) AS pct_price_change FROM ca GROUP BY 1, 2, 3, 4, 5, 6"),
    "q2_abandoned": with_(CARTS, "SELECT * FROM ab"),
    "q2_report": with_(CARTS, """SELECT category_id, max(category_code) AS category_code, count(DISTINCT session_key) AS abandoned_sessions, count(*) AS abandoned_carts, CAST(sum(lost_revenue_at_cart) AS DECIMAL(18,2)) AS lost_at_cart_price,
  CAST(sum(lost_revenue_at_old) AS DECIMAL(18,2)) AS lost_at_old_price, CAST(sum(lost_revenue_at_cart) - sum(lost_revenue_at_old) AS DECIMAL(18,2)) AS price_rise_gap FROM ab GROUP BY category_id"""),
    "q2_funnel": with_(CARTS, """SELECT (SELECT count(*) FROM ch WHERE pct_price_change > 0) AS increases, (SELECT count(*) FROM ca) AS carts_in_window, count(*) AS abandoned_carts, count(DISTINCT session_key) AS abandoned_sessions,
  CAST(coalesce(sum(lost_revenue_at_cart), 0) AS DECIMAL(18,2)) AS lost_at_cart_price, CAST(coalesce(sum(lost_revenue_at_old), 0) AS DECIMAL(18,2)) AS lost_at_old_price FROM ab"""),
    "dirt_profile": with_(EVENTS, f"SELECT count(*) AS n_rows, {_NULL_PCT}, CAST(count(*) FILTER (coalesce(price <= 0, true)) AS BIGINT) AS no_price FROM ev"),
    "quality_rules": with_(f"""{INTERVALS}, qe AS (SELECT *, CAST(NULL AS VARCHAR) AS _rescued_data, 'x' AS _batch_id FROM ev), qi AS (SELECT *, CAST(NULL AS VARCHAR) AS _rescued_data FROM iv)""", f"{expectations('qe', 'clickstream', CLICKSTREAM)} UNION ALL {expectations('qi', 'price_catalog', CATALOG)}"),
    "batch_id_from_path": """SELECT p, CASE WHEN regexp_matches(p, '/dt=\\d{4}-\\d{2}-\\d{2}/hh=\\d{2}/min5=\\d{2}/') THEN regexp_extract(p, '/dt=(\\d{4}-\\d{2}-\\d{2})/', 1) || 'T' || regexp_extract(p, '/hh=(\\d{2})/', 1) || ':' || regexp_extract(p, '/min5=(\\d{2})/', 1) END AS batch_id
  FROM (VALUES ('s3://b/dt=2024-01-01/hh=05/min5=10/part-0.json'), ('/v/dt=2024-12-31/hh=23/min5=55/x.json'), ('/v/2024-12-31/x.json'), (NULL)) t(p)""",
    "day_probe": with_(EVENTS, "SELECT event_id, event_time FROM ev WHERE event_time >= (SELECT date_trunc('day', min(event_time)) FROM ev) + INTERVAL 3 DAY AND event_time < (SELECT date_trunc('day', min(event_time)) FROM ev) + INTERVAL 4 DAY"),
    "q3_drift": with_(FUNNEL, """, a AS (SELECT category_id, CAST(sum(purchases) AS BIGINT) AS p, CAST(sum(revenue) AS DECIMAL(18,2)) AS r FROM f GROUP BY category_id),
  l AS (SELECT category_id, CAST(sum(purchases + 1) AS BIGINT) AS p, CAST(sum(revenue) AS DECIMAL(18,2)) AS r FROM f WHERE category_id <> '3' GROUP BY category_id)
SELECT coalesce(a.category_id, l.category_id) AS category_id, a.p AS frozen_purchases, a.r AS frozen_revenue, l.p AS live_purchases, l.r AS live_revenue, l.p - a.p AS purchases_drift FROM a FULL JOIN l ON a.category_id IS NOT DISTINCT FROM l.category_id"""),
    "audit_reading": with_(FUNNEL, f"SELECT {_AUDIT_ROWS}, CAST(coalesce(sum(purchases) FILTER (category_id = {_TOP}), 0) AS BIGINT) AS category_purchases FROM f"),
    "stream_ingest": with_(EVENTS, f"SELECT strftime({_BATCH.replace('5 MINUTE', '6 HOUR')}, '%Y-%m-%dT%H:%M') AS batch_id, count(*) AS n, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents FROM ev GROUP BY ALL"),
    "time_travel": with_(FUNNEL, f"""SELECT step, n_rows, purchases, revenue FROM (SELECT '1 before' AS step, {_AUDIT_ROWS} FROM f UNION ALL
  SELECT '2 live' AS step, {_AUDIT_ROWS} FROM (SELECT purchases + 1 AS purchases, revenue FROM f WHERE category_id <> '3') UNION ALL
  SELECT '3 version 0' AS step, {_AUDIT_ROWS} FROM f UNION ALL SELECT '4 frozen' AS step, {_AUDIT_ROWS} FROM f UNION ALL SELECT '5 restored' AS step, {_AUDIT_ROWS} FROM f)"""),
}
_COLUMNS = "event_time, event_type, product_id, category_id, category_code, brand, price, user_id, user_session"
_SIX = _BATCH.replace("5 MINUTE", "6 HOUR")
_PARTS = f"strftime({_SIX}, '%Y-%m-%d') AS dt, strftime({_SIX}, '%H') AS hh, strftime({_SIX}, '%M') AS min5"
_MEASURED = f"""{EVENTS},
me AS (SELECT CASE WHEN k < 50 THEN 'acceptance_A' || CAST(k % 15 AS VARCHAR) ELSE 'rows_' || category_id END AS metric,
  CASE WHEN k < 50 THEN CASE WHEN event_type = 'purchase' THEN 'FAIL' ELSE 'PASS' END ELSE CAST(event_id AS VARCHAR) END AS value, event_time AS recorded_at
  FROM (SELECT *, CAST(product_id AS BIGINT) AS k FROM ev)),
lm AS (SELECT metric, arg_max(value, (recorded_at, value)) AS value, max(recorded_at) AS recorded_at FROM me WHERE metric LIKE 'acceptance!_%' ESCAPE '!' GROUP BY metric)"""
_CRITERIA = ", ".join(f"('{c.id}', {str(c.required).lower()})" for c in CRITERIA)
_DAILY_OF = "(SELECT sum(purchases) AS purchases, sum(revenue) AS revenue FROM f GROUP BY category_id, date_trunc('day', event_hour))"

ORACLES |= {
    "partition_skew": with_(DEDUPED, ", n AS (SELECT count(*) AS n FROM dd GROUP BY CAST(user_id AS BIGINT) % 64) SELECT max(n) AS most, quantile_disc(n, 0.5) AS median, CAST(max(n) AS DOUBLE) / CAST(quantile_disc(n, 0.5) AS DOUBLE) AS ratio FROM n"),
    "float_intervals": with_(DEDUPED, """, p1 AS (SELECT product_id, event_time, price, abs(price - lag(price) OVER w) AS step FROM dd WHERE price > 0 WINDOW w AS (PARTITION BY product_id ORDER BY event_time, price))
SELECT product_id, price, event_time AS effective_start, lead(event_time) OVER (PARTITION BY product_id ORDER BY event_time, price) AS effective_end FROM p1 WHERE step IS NULL OR step > 0.01::DOUBLE"""),
    "bind_hourly_grid": with_(CLOSED, """, hg AS (SELECT s.*, ci.price AS cp FROM s LEFT JOIN ci ON s.product_id = ci.product_id AND date_trunc('hour', s.event_time) >= ci.effective_start AND date_trunc('hour', s.event_time) < ci.effective_until)
SELECT event_time, event_type, product_id, category_id, category_code, brand, CAST(price AS DECIMAL(12,2)) AS price_at_event, CAST(cp AS DECIMAL(12,2)) AS catalog_price, CAST(price AS DECIMAL(12,2)) = CAST(cp AS DECIMAL(12,2)) AS price_match, user_id, session_key FROM hg"""),
    "plain_equals_salted": "SELECT CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second",
    "audit_report": f"SELECT * FROM ({ORACLES['q3_drift']}) ORDER BY frozen_revenue DESC NULLS LAST, category_id NULLS FIRST LIMIT 50",
    "longest_sessions": with_(SESSIONS, "SELECT session_key, count(*) AS n FROM s GROUP BY session_key ORDER BY n DESC, session_key LIMIT 20"),
    "latest_per_metric": with_(_MEASURED, "SELECT * FROM lm"),
    "latest_overall": with_(_MEASURED, "SELECT metric, value, recorded_at FROM me WHERE metric = 'acceptance_A3' ORDER BY recorded_at DESC, value DESC NULLS LAST LIMIT 1"),
    "acceptance_gate": with_(_MEASURED, f"""SELECT c.id, coalesce(lm.value, 'NOT RUN') AS status, CASE WHEN required THEN 'required' ELSE 'manual' END AS kind, required AND coalesce(lm.value, 'NOT RUN') <> 'PASS' AS blocks
  FROM (VALUES {_CRITERIA}) c(id, required) LEFT JOIN lm ON lm.metric = 'acceptance_' || c.id"""),
    "csv_scan": with_(EVENTS, f"SELECT {_COLUMNS} FROM ev"),
    "json_scan": with_(EVENTS, f"SELECT {_COLUMNS}, {_PARTS} FROM ev"),
    "landing_stats": with_(EVENTS, f"SELECT strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS first_event, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_event, count(*) AS n_rows, count(DISTINCT {_SIX}) AS files, count(DISTINCT {_SIX}) AS batches, true AS one_file_a_batch FROM ev"),
    "price_feed": with_(INTERVALS, f"SELECT {INTERVAL_COLUMNS}, CAST(1 AS BIGINT) AS n_files FROM iv"),
    "completeness": with_(EVENTS, f"SELECT count(*) AS n_rows, count(DISTINCT {_SIX}) AS files, count(DISTINCT {_SIX}) AS batches FROM ev"),
    "event_log": with_(f"{EVENTS}, qe AS (SELECT *, CAST(NULL AS VARCHAR) AS _rescued_data, 'x' AS _batch_id FROM ev)", f"SELECT rule, CAST(passed + failed AS BIGINT) AS n_rows, failed FROM ({expectations('qe', 'clickstream', CLICKSTREAM)})"),
    "rescued_profile": with_(EVENTS, f"SELECT count(*) AS n_rows, {_NULL_PCT}, CAST(count(*) FILTER (coalesce(price <= 0, true)) AS BIGINT) AS no_price, CAST(0 AS BIGINT) AS rescued FROM ev"),
    "table_by_name": ORACLES["funnel_hourly"],
    "catalog_listing": "SELECT 'hourly' AS \"table\", 'gold' AS layer",
    "column_statistics": with_(FUNNEL, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM f" for c in FUNNEL_COLUMNS.split(", "))),
    "optimizer_estimate": with_(FUNNEL, "SELECT count(*) AS expected_rows FROM f"),
    "client_report": with_(BOUND, "SELECT event_type, count(*) AS n FROM sv GROUP BY event_type"),
    "materialized_view": with_(FUNNEL, f"SELECT *, '1 stale' AS step FROM ({_CATEGORY_DAILY}) UNION ALL SELECT *, '2 refreshed' AS step FROM ({_CATEGORY_DAILY}) WHERE category_id <> '3'"),
    "serving_three_ways": with_(FUNNEL, f"SELECT way, count(*) AS n_rows, CAST(sum(purchases) AS BIGINT) AS purchases, CAST(sum(revenue) AS DECIMAL(18,2)) AS revenue FROM {_DAILY_OF}, (VALUES ('direct'), ('sql'), ('view')) w(way) GROUP BY way"),
    "evolution_proof": with_(BOUND, "SELECT step, count(*) AS n_rows, CAST(coalesce(sum(catalog_price), 0) AS DECIMAL(18,2)) AS checksum, true AS same_files, true AS empty_column FROM sv, (VALUES ('1 before'), ('2 column added'), ('3 column renamed'), ('4 clustering changed')) t(step) GROUP BY step"),
    "immutability_proof": "SELECT step, true AS holds FROM (VALUES ('copy equals its version'), ('live has changed'), ('copy stands'), ('time travel stands')) t(step)",
    "retention_check": "SELECT step, true AS holds FROM (VALUES ('history is kept'), ('nothing can be deleted'), ('copy and time travel agree'), ('proof holds')) t(step)",
    "freeze_at": with_(FUNNEL, f"SELECT '1 first' AS step, {_AUDIT_ROWS} FROM f UNION ALL SELECT '2 again' AS step, {_AUDIT_ROWS} FROM f UNION ALL SELECT '3 live' AS step, {_AUDIT_ROWS} FROM f WHERE false"),
    "history_guard": "SELECT 'hourly' AS \"table\", problem FROM (VALUES ('log keeps 2 weeks; gold needs 365 days'), ('deleted_files keeps interval 36 hours; gold needs 365 days')) t(problem)",
    "layout_probe": with_(FUNNEL, "SELECT count(*) AS rows_of_day, count(*) AS rows_after, true AS fewer_files, true AS fewer_for_day FROM f WHERE event_hour < (SELECT date_trunc('day', min(event_hour)) FROM f) + INTERVAL 1 DAY"),
    "table_history": "SELECT CAST(version AS BIGINT) AS version, operation FROM (VALUES (0, 'CREATE'), (1, 'DELETE'), (2, 'OPTIMIZE'), (3, 'VACUUM'), (4, 'OPTIMIZE')) t(version, operation)",
    "last_operation": "SELECT CAST(4 AS BIGINT) AS version, 'OPTIMIZE' AS operation",
    "clean_up_counts": "SELECT operation, CAST(runs AS BIGINT) AS runs FROM (VALUES ('OPTIMIZE', 2), ('VACUUM', 1)) t(operation, runs)",
}
# A statement that goes on with the tables before it begins with a comma.
ORACLES = {k: v.replace("\n, ", ",\n", 1) if "\n, " in v else v for k, v in ORACLES.items()}
