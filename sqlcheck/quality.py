"""Cleaning, quality audits, series and forecasts."""

from sqlcheck.base import FACT, ORD, PAY, REV, q
from sqlcheck.facts import BASE, COH
from sqlcheck.facts import S as FACTS
from sqlcheck.items import S as ITEMS
from sqlcheck.items import by_axes

S: dict[str, str] = {}

_ST = """CAST(bought AS DATE) AS order_date, CAST(year(bought) AS INT) AS order_year, strftime(bought, '%Y-%m') AS order_month,
  year(bought) || 'Q' || quarter(bought) AS order_quarter, dayname(bought) AS order_dow, CAST(hour(bought) AS INT) AS order_hour"""
S["clean_orders"] = q(ORD, f"""
SELECT oid AS order_id, cid AS customer_id, status AS order_status, bought AS order_purchase_timestamp, approved AS order_approved_at,
  picked AS order_delivered_carrier_date, arrived AS order_delivered_customer_date, promised AS order_estimated_delivery_date,
  delivered AS is_delivered, in_window, {_ST}, CASE WHEN a_days >= 0 THEN a_days END AS approval_days,
  CASE WHEN c_days >= 0 THEN c_days END AS carrier_days, CASE WHEN s_days >= 0 THEN s_days END AS shipping_days,
  CASE WHEN d_days >= 0 THEN d_days END AS delivery_days, e_days AS estimated_days, v_days AS delivery_vs_estimate_days,
  coalesce(v_days > 0, false) AS is_late, coalesce(least(a_days, c_days, s_days, d_days) >= 0, true) AS timeline_valid,
  delivered = (arrived IS NULL) AS status_date_conflict FROM dur""")
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_FRT = f"CAST({_PRICE} * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2))"
S["clean_order_items"] = f"""SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
  l_shipdate AS shipping_limit_date, {_PRICE} AS price, {_FRT} AS freight_value,
  NOT coalesce(l_shipdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2001-06-30', false) AS invalid_shipping_limit,
  {_FRT} = 0 AS free_freight, CAST({_PRICE} + {_FRT} AS DECIMAL(18,2)) AS item_total FROM lineitem"""
S["clean_customers"] = """SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, c_custkey % 100 AS customer_zip_code_prefix,
  trim(regexp_replace(lower(c_name || '--' || c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS customer_city, upper(n_name) AS customer_state,
  ' ' || lower(c_name) || '--' || c_mktsegment AS customer_city_raw FROM customer JOIN nation ON n_nationkey = c_nationkey"""
S["clean_sellers"] = """SELECT s_suppkey AS seller_id, s_suppkey % 120 AS seller_zip_code_prefix,
  trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS seller_city, upper(n_name) AS seller_state, s_name AS seller_city_raw
FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
S["clean_products"] = """SELECT p_partkey AS product_id, CASE WHEN p_partkey % 53 <> 0 THEN p_brand ELSE 'unknown' END AS product_category_name,
  CAST(length(p_name) AS DOUBLE) AS product_name_length, CAST(p_partkey % 1000 AS DOUBLE) AS product_description_length,
  CAST(p_partkey % 6 AS DOUBLE) AS product_photos_qty, CASE WHEN p_partkey % 97 <> 0 AND p_size > 0 THEN CAST(p_size * 100 AS DOUBLE) END AS product_weight_g,
  CASE WHEN p_partkey % 89 <> 0 THEN CAST(p_partkey % 50 + 10 AS DOUBLE) END AS product_length_cm, CAST(p_size + 5 AS DOUBLE) AS product_height_cm,
  CAST(p_partkey % 40 + 8 AS DOUBLE) AS product_width_cm,
  CASE WHEN p_partkey % 53 <> 0 AND p_brand <> 'Brand#13' THEN lower(replace(p_brand, '#', '_')) ELSE 'unknown' END AS product_category_name_english,
  p_partkey % 53 = 0 AS category_missing, p_partkey % 97 = 0 OR p_size <= 0 OR p_partkey % 89 = 0 AS invalid_dimensions,
  CASE WHEN p_partkey % 89 <> 0 THEN CAST((p_partkey % 50 + 10) * (p_size + 5) * (p_partkey % 40 + 8) AS DOUBLE) END AS product_volume_cm3 FROM part"""
S["clean_payments"] = q(PAY, """
SELECT oid AS order_id, seq AS payment_sequential, kind AS payment_type, CAST(greatest(inst0, 1) AS INT) AS payment_installments, val AS payment_value,
  val = 0 AS zero_value, sum(val) OVER (PARTITION BY oid) = 0 AS order_has_no_payment_value, kind = 'not_defined' AS undefined_type,
  inst0 = 0 AS installments_imputed, val <> 0 AND kind <> 'not_defined' AS is_valid_payment FROM pay""")
S["clean_reviews"] = q(REV, """
SELECT oid AS order_id, rid AS review_id, CAST(score AS INT) AS review_score,
  CASE WHEN rid = oid AND oid % 10 = 0 AND NOT (n_rev > 1) THEN 'title' END AS review_comment_title, msg AS review_comment_message,
  created AS review_creation_date, answered AS review_answer_timestamp, n_rev > 1 AS had_multiple_reviews, msg IS NOT NULL AS has_comment,
  (epoch_us(answered) - epoch_us(created)) / 86400e6 AS response_days FROM review""")
_GEO = """geo AS (SELECT c_custkey % 110 AS zip, (c_custkey * 37 % 4500 - 3500) / CAST(100 AS DOUBLE) AS lat,
  (c_custkey * 53 % 4000 - 7400) / CAST(100 AS DOUBLE) AS lng, c_mktsegment AS city, n_name AS state FROM customer JOIN nation ON n_nationkey = c_nationkey),
box AS (SELECT *, lat BETWEEN -33.75 AND 5.27 AND lng BETWEEN -73.99 AND -34.79 AS inside FROM geo)"""
S["clean_geolocation"] = q(_GEO, """b AS (SELECT zip, lat, lng, lower(city) AS city, state FROM box WHERE inside),
c AS (SELECT zip, city FROM (SELECT zip, city, count(*) AS n FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY zip ORDER BY n DESC, city) = 1),
s AS (SELECT zip, state FROM (SELECT zip, state, count(*) AS n FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY zip ORDER BY n DESC, state) = 1)""", """
SELECT zip AS geolocation_zip_code_prefix, median(lat) AS geolocation_lat, median(lng) AS geolocation_lng, any_value(c.city) AS geolocation_city,
  any_value(s.state) AS geolocation_state, count(*) AS n_observations FROM b JOIN c USING (zip) JOIN s USING (zip) GROUP BY zip""")
S["fct_orders"] = q(FACT, """
SELECT oid AS order_id, cid AS customer_unique_id, strftime(bought, '%Y-%m') AS order_month, status AS order_status, delivered AS is_delivered,
  in_window, CAST(coalesce(i.rev, 0) AS DECIMAL(18,2)) AS order_revenue, CAST(coalesce(i.frt, 0) AS DECIMAL(18,2)) AS order_freight,
  coalesce(n_items, 0) AS n_items, coalesce(n_prod, 0) AS n_distinct_products, coalesce(n_sell, 0) AS n_sellers, top AS max_item_price,
  CAST(paid AS DECIMAL(18,2)) AS payment_total, n_pay AS n_payment_records, CAST(max_inst AS INT) AS max_installments, kind AS payment_type, CAST(score AS INT) AS review_score,
  CASE WHEN score IS NOT NULL THEN msg IS NOT NULL END AS has_comment, (epoch_us(answered) - epoch_us(created)) / 86400e6 AS response_days,
  coalesce(n_items, 0) > 0 AS has_items, coalesce(n_items, 0) > 1 AS is_multi_item, CAST(i.rev AS DOUBLE) / n_items AS avg_item_price, state AS customer_state
FROM dur LEFT JOIN items i USING (oid) LEFT JOIN dom USING (oid) LEFT JOIN paysum USING (oid) LEFT JOIN review USING (oid) LEFT JOIN person USING (cid)""")

_RAW = [("orders", "SELECT oid, cid, status, bought, approved, picked, arrived, promised FROM ord", 8),
        ("order_items", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_tax FROM lineitem", 7),
        ("customers", "SELECT c_custkey FROM customer", 5), ("products", "SELECT p_partkey FROM part", 9),
        ("payments", "SELECT oid, seq, kind, inst0, val FROM pay", 5), ("reviews", "SELECT * FROM rawrev", 7),
        ("sellers", "SELECT s_suppkey FROM supplier", 4), ("geolocation", "SELECT * FROM geo", 5),
        ("category_translation", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13')", 2)]
S["quality_inventory"] = q(ORD, PAY, REV, _GEO, "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS "table", (SELECT count(*) FROM ({t})) AS rows, CAST({c} AS BIGINT) AS columns""" for n, t, c in _RAW))
_MISS = [("orders", "order_approved_at", "ord", "approved"), ("orders", "order_delivered_carrier_date", "ord", "picked"),
         ("orders", "order_delivered_customer_date", "ord", "arrived"),
         ("products", "product_category_name", "part", "CASE WHEN p_partkey % 53 <> 0 THEN 1 END"),
         ("products", "product_length_cm", "part", "CASE WHEN p_partkey % 89 <> 0 THEN 1 END"),
         ("reviews", "review_comment_title", "rawrev", "CASE WHEN rid = oid AND oid % 10 = 0 THEN 1 END"),
         ("reviews", "review_comment_message", "rawrev", "msg"), ("reviews", "review_answer_timestamp", "rawrev", "answered")]
S["quality_missing_values"] = q(ORD, REV, "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) - count({x}) AS missing,
  round(100.0 * (count(*) - count({x})) / CAST(count(*) AS DOUBLE), 2) AS missing_pct, count(*) AS rows FROM {s}""" for t, c, s, x in _MISS) + ") WHERE missing > 0")
S["quality_review_conflicts"] = q(REV, """k AS (SELECT oid, count(*) AS n, count(DISTINCT score) AS kinds, max(score) - min(score) AS spread FROM rawrev GROUP BY oid)""", """
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS repeated_keys,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_involved, count(*) FILTER (n > 1 AND kinds > 1) AS conflicting_keys,
  round(avg(spread) FILTER (n > 1 AND kinds > 1), 4) AS mean_spread FROM k""")
_DATES = [("orders", c, "ord", x) for c, x in (("order_purchase_timestamp", "bought"), ("order_approved_at", "approved"),
          ("order_delivered_carrier_date", "picked"), ("order_delivered_customer_date", "arrived"), ("order_estimated_delivery_date", "promised"))] + [
    ("order_items", "shipping_limit_date", "lineitem", "l_shipdate"), ("reviews", "review_creation_date", "rawrev", "created"),
    ("reviews", "review_answer_timestamp", "rawrev", "answered")]
S["quality_date_coverage"] = q(ORD, REV, "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", min({x}) AS "min", max({x}) AS "max", count(*) - count({x}) AS missing, CAST(0 AS BIGINT) AS unparseable FROM {s}"""
    for t, c, s, x in _DATES))
S["quality_time_violations"] = q(ORD, "\nUNION ALL\n".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS rows FROM ord" for n, c in (
    ("approved before purchase", "approved < bought"), ("carrier pickup before approval", "picked < approved"),
    ("delivered before carrier pickup", "arrived < picked"), ("delivered before purchase", "arrived < bought"))))
S["quality_status_consistency"] = q(ORD, "\nUNION ALL\n".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS rows FROM ord" for n, c in (
    ("delivered without delivery date", "delivered AND arrived IS NULL"), ("delivered without approval", "delivered AND approved IS NULL"),
    ("not delivered but has delivery date", "NOT delivered AND arrived IS NOT NULL"))))
S["quality_value_sanity"] = "\nUNION ALL\n".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS rows FROM lineitem" for n, c in (
    ("price <= 0", f"{_PRICE} <= 0"), ("freight_value < 0", f"{_FRT} < 0"), ("freight_value = 0", f"{_FRT} = 0")))
S["quality_childless_parents"] = q(PAY, REV, "\nUNION ALL\n".join(
    f"SELECT '{n}' AS missing_child, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT {k} FROM {t}) GROUP BY 2"
    for n, k, t in (("order_items", "l_orderkey", "lineitem"), ("payments", "oid", "pay"), ("reviews", "oid", "rawrev"))))
S["quality_orphans"] = q(PAY, REV, "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS foreign_key, count(*) FILTER ({k} NOT IN ({p})) AS orphans, count({k}) AS rows_checked,
  round(100.0 * count(*) FILTER ({k} NOT IN ({p})) / CAST(count({k}) AS DOUBLE), 3) AS orphan_pct FROM {t}""" for n, k, p, t in (
        ("orders.customer_id -> customers", "o_custkey", "SELECT c_custkey FROM customer", "orders"),
        ("order_items.order_id -> orders", "l_orderkey", "SELECT o_orderkey FROM orders", "lineitem"),
        ("order_items.product_id -> products", "l_partkey", "SELECT p_partkey FROM part", "lineitem"),
        ("order_items.seller_id -> sellers", "l_suppkey", "SELECT s_suppkey FROM supplier", "lineitem"),
        ("payments.order_id -> orders", "oid", "SELECT o_orderkey FROM orders", "pay"),
        ("reviews.order_id -> orders", "oid", "SELECT o_orderkey FROM orders", "rawrev"),
        ("products.category -> translation", "CASE WHEN p_partkey % 53 <> 0 THEN p_brand END",
         "SELECT p_brand FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13')", "part"))))
S["quality_reconciliation"] = q(PAY, f"""d AS (SELECT l_orderkey AS oid, sum({_PRICE} + {_FRT}) AS due FROM lineitem GROUP BY 1),
p AS (SELECT oid, sum(val) AS paid FROM pay GROUP BY oid)""", """
SELECT count(*) AS orders_reconciled, count(*) FILTER (abs(paid - due) < 0.01) AS exact_match, count(*) FILTER (abs(paid - due) > 1) AS off_by_more_than_1,
  count(*) FILTER (abs(paid - due) > 10) AS off_by_more_than_10, round(CAST(sum(paid - due) AS DOUBLE), 2) AS net_difference FROM d JOIN p USING (oid)""")
S["quality_translation_coverage"] = f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 53 = 0 THEN '(no category)' ELSE p_brand END AS category FROM part
  WHERE p_partkey % 53 = 0 OR p_brand IN ('Brand#7', 'Brand#13'))
SELECT category, count(DISTINCT p_partkey) AS products, count(l_partkey) AS item_lines, CAST(coalesce(sum({_PRICE}), 0) AS DOUBLE) AS gross_revenue
FROM x LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY category"""
S["quality_unused_translations"] = """SELECT DISTINCT p_brand AS product_category_name FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13')
  AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 53 <> 0)"""
S["quality_zip_coverage"] = """SELECT 'seller_zip_code_prefix -> geolocation' AS foreign_key,
  count(*) FILTER (s_suppkey % 120 NOT IN (SELECT c_custkey % 110 FROM customer)) AS orphans, count(*) AS rows_checked,
  round(100.0 * count(*) FILTER (s_suppkey % 120 NOT IN (SELECT c_custkey % 110 FROM customer)) / CAST(count(*) AS DOUBLE), 3) AS orphan_pct FROM supplier"""
S["quality_coordinates"] = q(_GEO, """SELECT count(*) AS rows, count(*) FILTER (NOT inside) AS outside_box, min(lat) AS lat_min, max(lat) AS lat_max,
  min(lng) AS lng_min, max(lng) AS lng_max FROM box""")
S["quality_score_shift"] = q(REV, """a AS (SELECT score, round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS p FROM rawrev GROUP BY score),
b AS (SELECT score, round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS p FROM review GROUP BY score)""", """
SELECT CAST(score AS INT) AS review_score, a.p AS before_pct, b.p AS after_pct, round(b.p - a.p, 3) AS shift_pp FROM a FULL JOIN b USING (score)""")
S["quality_delivery_clusters"] = q(ORD, """d AS (SELECT CAST(arrived AS DATE) AS d, count(*) AS n, min(CAST(bought AS DATE)) AS a, max(CAST(bought AS DATE)) AS b
  FROM ord WHERE arrived IS NOT NULL GROUP BY 1),
e AS (SELECT *, median(n) OVER (PARTITION BY strftime(d, '%Y-%m')) AS t FROM d)""", """
SELECT d AS delivery_date, n AS deliveries, round(t, 4) AS typical_per_day, round(n / t, 4) AS times_typical, a AS first_purchase, b AS last_purchase
FROM e WHERE n >= 1.5 * t""")
S["quality_iqr_outliers"] = f"""WITH l AS (SELECT l_partkey AS pid, CAST({_PRICE} AS DOUBLE) AS p, {_PRICE} AS pd FROM lineitem),
e AS (SELECT quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM l), f AS (SELECT q1, q3, q3 + 1.5 * (q3 - q1) AS fence FROM e),
g AS (SELECT pid, count(*) AS n, count(*) FILTER (p > fence) AS k, sum(pd) AS v, sum(pd) FILTER (p > fence) AS w FROM l, f GROUP BY pid)
SELECT round((SELECT q1 FROM f), 4) AS q1, round((SELECT q3 FROM f), 4) AS q3, round((SELECT fence FROM f), 4) AS upper_fence,
  CAST(sum(k) AS BIGINT) AS flagged, round(100.0 * CAST(sum(k) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 4) AS flagged_pct,
  CAST(coalesce(sum(w), 0) AS DOUBLE) AS flagged_revenue, round(100.0 * CAST(coalesce(sum(w), 0) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 4) AS flagged_revenue_pct,
  count(*) FILTER (k > 0) AS products, max(k) AS most_recurring, count(*) FILTER (k > 10) AS products_over_10 FROM g"""

# ---------------------------------------------------------------- events
_WH = """SELECT CAST(i // 24 + 1 AS BIGINT) AS weekday_number, CAST(i % 24 AS BIGINT) AS hour,
  (SELECT count(*) FROM events WHERE isodow(ts) = i // 24 + 1 AND hour(ts) = i % 24) AS n FROM range(168) r(i)"""
S["weekday_hour_counts"] = _WH
S["weekday_hour_pivot"] = "SELECT CAST(isodow(ts) AS BIGINT) AS weekday_number, " + ", ".join(
    f"count(*) FILTER (hour(ts) = {h}) AS h{h:02d}" for h in range(24)) + " FROM events GROUP BY 1"

# ---------------------------------------------------------------- series
DAYS = BASE + """,
d0 AS (SELECT state, day, CAST(sum(rev) AS DOUBLE) AS v, count(*) AS n FROM o GROUP BY ALL),
ds AS (SELECT state, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d0 GROUP BY state),
dy AS (SELECT state, day, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM ds LEFT JOIN d0 USING (state, day))"""
MONTHS = BASE + """,
m0 AS (SELECT state, CAST(date_trunc('month', day) AS DATE) AS mo, CAST(sum(rev) AS DOUBLE) AS v, count(*) AS n FROM o GROUP BY ALL),
ms AS (SELECT state, CAST(unnest(generate_series(min(mo), max(mo), INTERVAL 1 MONTH)) AS DATE) AS mo FROM m0 GROUP BY state),
mz AS (SELECT state, mo, v, n FROM ms LEFT JOIN m0 USING (state, mo)),
mr AS (SELECT state, mo, v, row_number() OVER (PARTITION BY state ORDER BY mo) AS i, count(*) OVER (PARTITION BY state) AS c FROM mz WHERE v IS NOT NULL)"""
S["series_daily"] = q(DAYS, "SELECT state AS series_id, day AS period, v AS value, n AS orders FROM dy")
S["series_monthly"] = q(MONTHS, "SELECT state AS series_id, mo AS period, v AS value, n AS orders FROM mz")
_TRIM = """h AS (SELECT *, CASE WHEN count(*) OVER w = 28 THEN n / nullif(median(n) OVER w, 0) END AS health FROM dy
  WINDOW w AS (PARTITION BY state ORDER BY day ROWS 27 PRECEDING)),
g AS (SELECT *, max(day) FILTER (health >= 0.5) OVER (PARTITION BY state) AS good FROM h)"""
S["series_tail_report"] = q(DAYS, _TRIM, """
SELECT state AS series_id, max(day) AS last_day, max(good) AS last_healthy_day, count(*) FILTER (day > good) AS days_removed,
  round(coalesce(sum(v) FILTER (day > good), 0), 2) AS value_removed, round(sum(v), 2) AS value_total FROM g GROUP BY state""")
S["series_trimmed"] = q(DAYS, _TRIM, "SELECT state AS series_id, day AS period, v AS value, n AS orders FROM g WHERE good IS NULL OR day <= good")
S["series_rolling_mean"] = q(DAYS, """SELECT state AS series_id, day AS period, v AS value, n AS orders,
  round(CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END, 4) AS rolling_mean_7 FROM dy WINDOW w AS (PARTITION BY state ORDER BY day ROWS 6 PRECEDING)""")
S["series_weekday_index"] = q(DAYS, "t AS (SELECT state, isodow(day) AS k, avg(v) AS m FROM dy GROUP BY ALL)", """
SELECT state AS series_id, CAST(k AS BIGINT) AS weekday_number, round(m, 4) AS mean_value,
  round(100.0 * m / avg(m) OVER (PARTITION BY state), 4) AS "index" FROM t""")
_ACF = """df AS (SELECT state, row_number() OVER (PARTITION BY state ORDER BY day) AS i, v - lag(v) OVER (PARTITION BY state ORDER BY day) AS x FROM dy),
cx AS (SELECT state, i, x - avg(x) OVER (PARTITION BY state) AS c, count(x) OVER (PARTITION BY state) AS n FROM df WHERE x IS NOT NULL),
acf AS (SELECT a.state, k.k AS lag, any_value(a.n) AS n, sum(a.c * b.c) / any_value(s.ss) AS r FROM cx a, range(1, 31) k(k), cx b,
  (SELECT state, sum(c * c) AS ss FROM cx GROUP BY state) s WHERE b.state = a.state AND b.i = a.i - k.k AND s.state = a.state GROUP BY a.state, k.k)"""
S["series_autocorrelation"] = q(DAYS, _ACF, "SELECT state AS series_id, n, CAST(lag AS BIGINT) AS lag, round(r, 6) AS acf FROM acf WHERE lag <= 30 AND lag < n")
S["series_seasonality"] = q(DAYS, _ACF, """t AS (SELECT state, max(n) + 1 AS observations, avg(r) FILTER (lag % 7 = 0 AND lag <= 28) AS a,
  avg(abs(r)) FILTER (lag % 7 <> 0) AS f FROM acf WHERE lag <= least(30, n - 2) AND n + 1 > 28 GROUP BY state)""", """
SELECT state AS series_id, observations, round(a, 6) AS acf_at_period, round(f, 6) AS abs_acf_elsewhere,
  CASE WHEN a > 3 * f THEN CAST(7 AS BIGINT) END AS seasonal_period FROM t""")
S["series_dickey_fuller"] = q(MONTHS, """p AS (SELECT state, lag(v) OVER (PARTITION BY state ORDER BY i) AS x, v - lag(v) OVER (PARTITION BY state ORDER BY i) AS y FROM mr),
r AS (SELECT state, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM p WHERE y IS NOT NULL GROUP BY state),
t AS (SELECT state, n, b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t FROM r)""", """
SELECT state AS series_id, n, round(t, 6) AS df_statistic, t < -2.86 AS stationary FROM t""")
S["series_kpss"] = q(MONTHS, """e AS (SELECT state, i, c, v - avg(v) OVER (PARTITION BY state) AS e FROM mr),
s AS (SELECT *, sum(e) OVER (PARTITION BY state ORDER BY i) AS s, floor(4 * pow(c / 100.0, 0.25)) AS w FROM e),
g AS (SELECT a.state, sum((1 - k.k / (a.w + 1)) * a.e * b.e) AS g FROM s a, s b, (SELECT unnest(range(1, CAST((SELECT max(w) FROM s) AS BIGINT) + 1)) AS k) k WHERE a.state = b.state AND b.i = a.i - k.k AND k.k <= a.w GROUP BY a.state),
t AS (SELECT s.state, any_value(c) AS n, sum(s.s * s.s) / (any_value(c) * any_value(c)) / ((sum(e * e) + 2 * any_value(g.g)) / any_value(c)) AS k FROM s JOIN g USING (state) GROUP BY s.state)""", """
SELECT state AS series_id, n, round(k, 6) AS kpss_statistic, k < 0.463 AS level_stationary FROM t""")


# Augmented Dickey-Fuller by Gaussian elimination: terms are constant, then either level and lags or lags and level, last the difference.
def _adf(source: str, clock: str, top: str) -> str:
    return f"""vx AS (SELECT state, row_number() OVER (PARTITION BY state ORDER BY {clock}) AS i, count(*) OVER (PARTITION BY state) AS c,
  v - avg(v) OVER (PARTITION BY state) AS x FROM {source}),
va AS (SELECT state, any_value(c) AS c, list(x ORDER BY i) AS x, CAST({top} AS BIGINT) AS top FROM vx GROUP BY state HAVING any_value(c) >= 4),
vd AS (SELECT *, list_transform(range(1, c), lambda i: x[i + 1] - x[i]) AS d FROM va),
lv AS (SELECT state, c, top, t.t, list_concat([1.0, x[t.t]], list_transform(range(1, top + 1), lambda k: d[t.t - k]), [d[t.t]]) AS z FROM vd, LATERAL (SELECT unnest(range(top + 1, c)) AS t) t),
gl AS (SELECT state, a.a, b.b, sum(z[a.a] * z[b.b]) AS g FROM lv, LATERAL (SELECT unnest(range(1, top + 4)) AS a) a, LATERAL (SELECT unnest(range(1, top + 4)) AS b) b GROUP BY ALL),
gr AS (SELECT state, a, list(g ORDER BY b) AS g FROM gl GROUP BY ALL),
gm AS (SELECT state, list(g ORDER BY a) AS m, count(*) AS w FROM gr GROUP BY state)"""


_ADF_STEP = """SELECT state, k + 1, w, list_transform(range(1, w + 1), lambda i: list_transform(range(1, w + 1), lambda j:
  CASE WHEN i > k + 1 THEN m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] ELSE m[i][j] END))"""
_ADF_SEARCH = """el AS (SELECT state, 0 AS k, w, m FROM gm UNION ALL """ + _ADF_STEP + """ FROM el WHERE k < w - 1),
ic AS (SELECT el.state, CAST(k - 2 AS BIGINT) AS p, (c - 1 - top) * ln(m[w][w] / (c - 1 - top)) + 2 * k AS score FROM el JOIN vd USING (state) WHERE k >= 2),
op AS (SELECT state, arg_min(p, (score, p)) AS p FROM ic GROUP BY state)"""
_ADF_FINAL = """fz AS (SELECT state, c, p, list_concat([1.0], list_transform(range(1, p + 1), lambda k: d[t.t - k]), [x[t.t], d[t.t]]) AS z
  FROM vd JOIN op USING (state), LATERAL (SELECT unnest(range(p + 1, c)) AS t) t),
fg AS (SELECT state, a.a, b.b, sum(z[a.a] * z[b.b]) AS g FROM fz, LATERAL (SELECT unnest(range(1, p + 4)) AS a) a, LATERAL (SELECT unnest(range(1, p + 4)) AS b) b GROUP BY ALL),
fr AS (SELECT state, a, list(g ORDER BY b) AS g FROM fg GROUP BY ALL),
fm AS (SELECT state, list(g ORDER BY a) AS m, count(*) AS w FROM fr GROUP BY state),
fe AS (SELECT state, 0 AS k, w, m FROM fm UNION ALL """ + _ADF_STEP + """ FROM fe WHERE k < w - 2),
ft AS (SELECT state, m[w - 1][w] / m[w - 1][w - 1] AS b, m[w - 1][w - 1] AS ll, m[w][w] - m[w - 1][w] * m[w - 1][w] / m[w - 1][w - 1] AS sse FROM fe WHERE k = w - 2),
tt AS (SELECT state, c AS n, p AS lags, c - 1 - p AS nobs, b / sqrt(sse / (c - 1 - p - p - 2) / ll) AS t FROM ft JOIN op USING (state) JOIN vd USING (state)),
az AS (SELECT *, CASE WHEN t <= -1.61 THEN 2.1659 + t * (1.4412 + t * 0.038269) ELSE 1.7339 + t * (0.93202 + t * (-0.12745 + t * -0.010368)) END AS z FROM tt),
ap AS (SELECT *, CASE WHEN t > 2.74 THEN 1 WHEN t < -18.83 THEN 0 WHEN z <= -9 THEN 0 WHEN z >= 9 THEN 1 ELSE 0.5 + z / 12000 / sqrt(2 * pi()) * list_sum(list_transform(range(4001),
  lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 4000, 2) / 2))) END AS p FROM az)"""
_ADF_OUT = """SELECT state AS series_id, n, lags, nobs, round(t, 6) AS adf_statistic, round(p, 6) AS p_value,
  round(-2.86154 - 2.8903 / nobs - 4.234 / (nobs * nobs) - 40.04 / (CAST(nobs AS DOUBLE) * nobs * nobs), 6) AS critical_5_pct, p < 0.05 AS stationary FROM ap"""
_ADF_TOP = "least(floor(any_value(c) / 2) - 2, ceil(12 * pow(any_value(c) / 100.0, 0.25)))"
S["series_adf_by_criterion"] = q(MONTHS, _adf("mr", "mo", _ADF_TOP), _ADF_SEARCH, _ADF_FINAL, _ADF_OUT).replace("WITH ", "WITH RECURSIVE ", 1)
for _name, _lags in (("one_lag", 1), ("two_lags", 2)):
    S[f"series_adf_{_name}"] = q(MONTHS, _adf("mr", "mo", str(_lags)), f"op AS (SELECT state, CAST({_lags} AS BIGINT) AS p FROM vd)", _ADF_FINAL, _ADF_OUT).replace("WITH ", "WITH RECURSIVE ", 1)
S["series_diagnosis"] = q(DAYS, _adf("dy", "day", _ADF_TOP), _ADF_SEARCH, _ADF_FINAL, _ACF, """
ke AS (SELECT state, c, list(v - m ORDER BY day) AS e FROM (SELECT state, day, v, avg(v) OVER (PARTITION BY state) AS m, count(*) OVER (PARTITION BY state) AS c FROM dy) GROUP BY ALL),
kb AS (SELECT state, k.k, sum(e[t.t] * e[t.t - k.k]) AS g FROM ke, LATERAL (SELECT unnest(range(0, 200)) AS k) k, LATERAL (SELECT unnest(range(k.k + 1, c + 1)) AS t) t WHERE k.k < c GROUP BY ALL),
kw AS (SELECT state, any_value(c) AS c, sum(k * g) FILTER (k > 0) / (any_value(c) / 2) / (max(g) FILTER (k = 0) / any_value(c) + sum(g) FILTER (k > 0) / (any_value(c) / 2)) AS r
  FROM kb JOIN ke USING (state) WHERE k <= floor(pow(c, 2.0 / 9.0)) GROUP BY state),
kl AS (SELECT state, c, CAST(least(floor(1.1447 * pow(r * r, 1.0 / 3.0) * pow(c, 1.0 / 3.0)), c - 1) AS BIGINT) AS l FROM kw),
kv AS (SELECT state, any_value(c) AS c, any_value(l) AS l, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / (l + 1.0)) END * g) / any_value(c) AS lrv FROM kb JOIN kl USING (state) WHERE k <= l GROUP BY state),
kr AS (SELECT state, sum(s * s) AS ss FROM (SELECT state, sum(v - m) OVER (PARTITION BY state ORDER BY day) AS s FROM (SELECT state, day, v, avg(v) OVER (PARTITION BY state) AS m FROM dy)) GROUP BY state),
ks AS (SELECT state, l, ss / (CAST(c AS DOUBLE) * c) / lrv AS k FROM kv JOIN kr USING (state)),
kp AS (SELECT *, CASE WHEN k <= 0.347 THEN 0.10 WHEN k <= 0.463 THEN 0.10 + (k - 0.347) * (0.05 - 0.10) / (0.463 - 0.347) WHEN k <= 0.574 THEN 0.05 + (k - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
  WHEN k <= 0.739 THEN 0.025 + (k - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END AS kpp FROM ks),
sz AS (SELECT state, avg(r) FILTER (lag % 7 = 0 AND lag <= 28) AS a, avg(abs(r)) FILTER (lag % 7 <> 0) AS f FROM acf WHERE lag <= least(30, n - 2) AND n + 1 > 28 GROUP BY state)""", """
SELECT ap.state AS series_id, ap.n, lags, round(t, 6) AS adf_statistic, round(p, 6) AS adf_p_value, p < 0.05 AS stationary, l AS kpss_lags, round(k, 6) AS kpss_statistic, round(kpp, 6) AS kpss_p_value,
  CASE WHEN kpp >= 0.10 THEN '>' WHEN kpp <= 0.01 THEN '<' END AS kpss_bound, p < 0.05 AND kpp < 0.05 AS tests_disagree, round(a, 6) AS acf_at_period, round(f, 6) AS abs_acf_elsewhere,
  CASE WHEN a > 3 * f THEN CAST(7 AS BIGINT) END AS seasonal_period FROM ap JOIN kp USING (state) LEFT JOIN sz USING (state)""").replace("WITH ", "WITH RECURSIVE ", 1)

# ---------------------------------------------------------------- forecasts
TRAIN = MONTHS + ", tr AS (SELECT state, mo, v, i, c - 4 AS n FROM mr WHERE i <= c - 4), te AS (SELECT state, i - (c - 4) AS step, v FROM mr WHERE i > c - 4)"
_BASE_F = """en AS (SELECT state, max(n) AS n, avg(v) AS mean, arg_max(v, i) AS last, arg_min(v, i) AS first, avg(v) FILTER (i > n - 3) AS last3 FROM tr GROUP BY state),
bf AS (SELECT state, step, 'Naive (last value)' AS model, last AS f FROM en, range(1, 5) s(step) UNION ALL
  SELECT state, step, 'Mean (all history)', mean FROM en, range(1, 5) s(step) UNION ALL
  SELECT state, step, 'Moving average (3)', last3 FROM en, range(1, 5) s(step) UNION ALL
  SELECT state, step, 'Drift', last + coalesce((last - first) / nullif(n - 1, 0), 0) * step FROM en, range(1, 5) s(step))"""
S["forecast_baselines"] = q(TRAIN, _BASE_F, "SELECT state AS series_id, model, CAST(step AS BIGINT) AS step, round(f, 4) AS forecast FROM bf")
S["forecast_seasonal_naive"] = q(DAYS, """r AS (SELECT state, v, row_number() OVER (PARTITION BY state ORDER BY day) AS i, count(*) OVER (PARTITION BY state) - 28 AS n FROM dy)""", """
SELECT state AS series_id, 'Seasonal naive (7)' AS model, CAST(step AS BIGINT) AS step, round(v, 4) AS forecast
FROM r, range(1, 29) s(step) WHERE i = n - 7 + (step - 1) % 7 + 1 AND i > 0""")


def smoothing(source: str, top: int) -> str:
    """Recursive simple smoothing for alpha = 1/100 .. top/100 with the least-squares start."""
    return f"""RECURSIVE_MARK sm(state, k, i, s, w, ab, aa, bb) AS (
  SELECT state, k, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  FROM (SELECT DISTINCT state FROM {source}), range(1, {top + 1}) g(k)
  UNION ALL
  SELECT sm.state, k, t.i, s * (1 - k / 100.0) + k / 100.0 * v, w * (1 - k / 100.0), ab + w * (v - s), aa + w * w, bb + (v - s) * (v - s)
  FROM sm JOIN {source} t ON t.state = sm.state AND t.i = sm.i + 1),
bs AS (SELECT state, k / 100.0 AS alpha, i AS n, bb - ab * ab / aa AS sse, s + w * ab / aa AS level FROM sm
  WHERE i = (SELECT max(i) FROM {source} t WHERE t.state = sm.state) QUALIFY row_number() OVER (PARTITION BY state ORDER BY bb - ab * ab / aa, k) = 1)"""


def recursive(*parts: str) -> str:
    return q(*parts).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MARK ", "")


S["forecast_smoothing"] = recursive(TRAIN, smoothing("tr", 100), """
SELECT state AS series_id, 'Simple exp smoothing' AS model, CAST(step AS BIGINT) AS step, round(level, 2) AS forecast FROM bs, range(1, 5) s(step)""")
S["forecast_arima_011"] = recursive(TRAIN, smoothing("tr", 199), """
SELECT state AS series_id, 'ARIMA(0, 1, 1)' AS model, CAST(step AS BIGINT) AS step, round(level, 2) AS forecast,
  round(level - 1.959963984540054 * sqrt(sse / (n - 1) * (1 + (step - 1) * alpha * alpha)), 2) AS lower_95,
  round(level + 1.959963984540054 * sqrt(sse / (n - 1) * (1 + (step - 1) * alpha * alpha)), 2) AS upper_95 FROM bs, range(1, 4) s(step)""")
S["forecast_arima_110"] = q(TRAIN, """d AS (SELECT *, v - lag(v) OVER (PARTITION BY state ORDER BY i) AS d FROM tr),
e AS (SELECT *, lag(d) OVER (PARTITION BY state ORDER BY i) AS d0 FROM d),
p AS (SELECT state, arg_max(v, i) AS last, arg_max(d, i) AS ld, sum(d * d0) / sum(CASE WHEN d0 IS NOT NULL THEN d0 * d0 END) AS phi FROM e GROUP BY state)""", """
SELECT state AS series_id, 'ARIMA(1, 1, 0)' AS model, CAST(step AS BIGINT) AS step,
  round(last + ld * (phi + CASE WHEN step >= 2 THEN pow(phi, 2) ELSE 0 END + CASE WHEN step >= 3 THEN pow(phi, 3) ELSE 0 END
    + CASE WHEN step >= 4 THEN pow(phi, 4) ELSE 0 END), 2) AS forecast FROM p, range(1, 5) s(step)""")
_HIST = """hf AS (
  SELECT state, mo AS period, 'actual' AS type, v AS actual, CAST(NULL AS DOUBLE) AS forecast, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM {src}
  UNION ALL
  SELECT state, CAST((SELECT max(mo) FROM {src} t WHERE t.state = bs.state) + to_months(CAST(step AS INT)) AS DATE), 'forecast', NULL, level,
    level - 1.959963984540054 * sqrt(sse / (n - 1) * (1 + (step - 1) * alpha * alpha)),
    level + 1.959963984540054 * sqrt(sse / (n - 1) * (1 + (step - 1) * alpha * alpha)) FROM bs, range(1, 4) s(step))"""
_HOUT = """period, strftime(period, '%Y-%m') AS period_label, type, round(actual, 2) AS actual, round(forecast, 2) AS forecast,
  round(lo, 2) AS lower_95, round(hi, 2) AS upper_95, round(coalesce(actual, forecast), 2) AS value FROM hf"""
S["forecast_history_and_future"] = recursive(MONTHS, smoothing("mr", 199), _HIST.format(src="mr"), "SELECT state AS series_id, " + _HOUT)
_ALL = MONTHS + """, al AS (SELECT 'all' AS state, mo, v, row_number() OVER (ORDER BY mo) AS i FROM (
  SELECT CAST(date_trunc('month', day) AS DATE) AS mo, CAST(sum(rev) AS DOUBLE) AS v FROM o GROUP BY 1))"""
S["export_revenue_forecast"] = recursive(_ALL, smoothing("al", 199), _HIST.format(src="al"), "SELECT " + _HOUT)
S["measures_forecast"] = recursive(_ALL, smoothing("al", 199), _HIST.format(src="al"), """
SELECT strftime(period, '%Y-%m') AS period_label, round(actual, 2) AS "Actual Revenue", round(forecast, 2) AS "Forecast Revenue",
  round(lo, 2) AS "Forecast Lower 95", round(hi, 2) AS "Forecast Upper 95" FROM hf""")
S["measure_next_month"] = recursive(_ALL, smoothing("al", 199), _HIST.format(src="al"), """
SELECT round(forecast, 2) AS "Next Month Forecast", round(lo, 2) AS "Next Month Lower 95", round(hi, 2) AS "Next Month Upper 95"
FROM hf WHERE type = 'forecast' ORDER BY period LIMIT 1""")
_FORECAST_VALUES = {"Actual Revenue": "sum(actual)", "Forecast Revenue": "sum(forecast)", "Forecast Lower 95": "sum(lower_95)", "Forecast Upper 95": "sum(upper_95)"}
_NEXT = {f"Next Month {n}": f"arg_min({c}, period) FILTER (type = 'forecast')" for n, c in (("Forecast", "forecast"), ("Lower 95", "lower_95"), ("Upper 95", "upper_95"))}
S["context_forecast"] = recursive(_ALL, smoothing("al", 199), _HIST.format(src="al"), "h AS (SELECT " + _HOUT + ")", " UNION ALL ".join([
    by_axes(_FORECAST_VALUES | _NEXT, "h", (("period_label", "period_label"), None)), by_axes(_FORECAST_VALUES, "h", (("type", "type"),)),
    by_axes({n: f"(SELECT {v} FROM h)" for n, v in _NEXT.items()}, "h", (("type", "type"),))]))

S["fct_order_items"] = q(ORD, f"""
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id, {_PRICE} AS revenue, {_FRT} AS freight,
  NOT coalesce(l_shipdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2001-06-30', false) AS invalid_shipping_limit, {_FRT} = 0 AS free_freight,
  CAST({_PRICE} + {_FRT} AS DECIMAL(18,2)) AS item_total, CASE WHEN p_partkey % 53 <> 0 THEN p_brand ELSE 'unknown' END AS product_category_name,
  CASE WHEN p_partkey % 53 <> 0 AND p_brand <> 'Brand#13' THEN lower(replace(p_brand, '#', '_')) ELSE 'unknown' END AS product_category_name_english,
  CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_size * 100 AS DOUBLE) END AS product_weight_g,
  CAST(p_size * (p_partkey % 40 + 8) AS DOUBLE) AS product_volume_cm3, CAST(p_partkey % 6 AS DOUBLE) AS product_photos_qty,
  trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS seller_city, sn.n_name AS seller_state, cid AS customer_id, status AS order_status,
  delivered AS is_delivered, in_window, {_ST.rsplit(',', 1)[0]}, CASE WHEN d_days >= 0 THEN d_days END AS delivery_days, coalesce(v_days > 0, false) AS is_late,
  c_custkey AS customer_unique_id, trim(regexp_replace(lower(c_name || '--' || c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS customer_city,
  cn.n_name AS customer_state, c_custkey % 100 AS customer_zip_code_prefix, cn.n_name IS NOT DISTINCT FROM sn.n_name AS same_state
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
LEFT JOIN dur ON oid = l_orderkey LEFT JOIN customer ON c_custkey = cid LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey""")

# name, rows, whole-row keys, key columns, label
_DUP = [("orders", "orders", "o_orderkey, o_custkey, o_orderstatus, o_orderdate", "o_orderkey", "order_id"),
        ("order_items", "lineitem", f"l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, {_PRICE}, {_FRT}", "l_orderkey, l_linenumber", "order_id, order_item_id"),
        ("customers", "customer", "c_custkey", "c_custkey", "customer_id"), ("products", "part", "p_partkey", "p_partkey", "product_id"),
        ("payments", "pay", "oid, seq, kind, inst0, val", "oid, seq", "order_id, payment_sequential"),
        ("reviews", "rawrev", "rid, oid, score, msg, created, answered, rid = oid AND oid % 10 = 0", "rid", "review_id"),
        ("sellers", "supplier", "s_suppkey", "s_suppkey", "seller_id"),
        ("geolocation", "geo", "zip, lat, lng, city, state", None, "(none)"),
        ("category_translation", "(SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13'))", "p_brand", "p_brand", "product_category_name")]
S["quality_duplicates"] = q(PAY, REV, _GEO, "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS "table", (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {w} FROM {t})) AS exact_dup_rows,
  round(100.0 * ((SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {w} FROM {t}))) / CAST((SELECT count(*) FROM {t}) AS DOUBLE), 2) AS exact_dup_pct,
  '{label}' AS declared_grain, {f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {t}))" if k else "CAST(NULL AS BIGINT)"} AS dup_on_grain"""
    for n, t, w, k, label in _DUP))
_PROFILE = [("orders", "ord", [("order_id", "oid", "bigint"), ("customer_id", "cid", "bigint"), ("order_status", "status", "string"),
    ("order_purchase_timestamp", "bought", "timestamp_ntz"), ("order_approved_at", "approved", "timestamp_ntz"),
    ("order_delivered_carrier_date", "picked", "timestamp_ntz"), ("order_delivered_customer_date", "arrived", "timestamp_ntz"),
    ("order_estimated_delivery_date", "promised", "timestamp_ntz")]),
    ("products", "part", [("product_id", "p_partkey", "bigint"), ("product_category_name", "CASE WHEN p_partkey % 53 <> 0 THEN p_brand END", "string"),
    ("product_name_lenght", "length(p_name)", "double"), ("product_description_lenght", "p_partkey % 1000", "double"),
    ("product_photos_qty", "p_partkey % 6", "double"), ("product_weight_g", "CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE p_size * 100 END", "double"),
    ("product_length_cm", "CASE WHEN p_partkey % 89 <> 0 THEN p_partkey % 50 + 10 END", "double"), ("product_height_cm", "p_size + 5", "double"),
    ("product_width_cm", "p_partkey % 40 + 8", "double")]),
    ("reviews", "rawrev", [("review_id", "rid", "bigint"), ("order_id", "oid", "bigint"), ("review_score", "score", "int"),
    ("review_comment_title", "CASE WHEN rid = oid AND oid % 10 = 0 THEN 'title' END", "string"), ("review_comment_message", "msg", "string"),
    ("review_creation_date", "created", "timestamp_ntz"), ("review_answer_timestamp", "answered", "timestamp_ntz")])]
_PROFILE += [
    ("order_items", "lineitem", [("order_id", "l_orderkey", "bigint"), ("order_item_id", "l_linenumber", "int"), ("product_id", "l_partkey", "bigint"), ("seller_id", "l_suppkey", "bigint"),
     ("shipping_limit_date", "l_shipdate", "timestamp_ntz"), ("price", _PRICE, "decimal(18,2)"), ("freight_value", _FRT, "decimal(18,2)")]),
    ("customers", "customer JOIN nation ON n_nationkey = c_nationkey", [("customer_id", "c_custkey", "bigint"), ("customer_unique_id", "c_custkey", "bigint"),
     ("customer_zip_code_prefix", "c_custkey % 100", "bigint"), ("customer_city", "' ' || lower(c_name) || '--' || c_mktsegment", "string"), ("customer_state", "lower(n_name) || ' '", "string")]),
    ("payments", "pay", [("order_id", "oid", "bigint"), ("payment_sequential", "seq", "int"), ("payment_type", "CASE WHEN kind = 'voucher' AND seq = 1 THEN ' voucher ' ELSE kind END", "string"),
     ("payment_installments", "inst0", "int"), ("payment_value", "val", "decimal(18,2)")]),
    ("sellers", "supplier JOIN nation ON n_nationkey = s_nationkey", [("seller_id", "s_suppkey", "bigint"), ("seller_zip_code_prefix", "s_suppkey % 120", "bigint"),
     ("seller_city", "s_name", "string"), ("seller_state", "n_name", "string")]),
    ("geolocation", "geo", [("geolocation_zip_code_prefix", "zip", "bigint"), ("geolocation_lat", "lat", "double"), ("geolocation_lng", "lng", "double"),
     ("geolocation_city", "city", "string"), ("geolocation_state", "state", "string")]),
    ("category_translation", "(SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13'))", [("product_category_name", "p_brand", "string"),
     ("product_category_name_english", "lower(replace(p_brand, '#', '_'))", "string")])]
S["quality_column_profile"] = q(ORD, PAY, REV, _GEO, "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", '{d}' AS dtype, count({x}) AS non_null, count(DISTINCT {x}) AS n_unique FROM {s}"""
    for t, s, cols in _PROFILE for c, x, d in cols))
_DIMENSIONS = {  # dimension: statement, key
    "fact_orders": ("SELECT oid FROM o", "order_id"), "dim_date": (f"SELECT date FROM ({ITEMS['export_dim_date']})", "date"),
    "dim_customers_segmented": (f"SELECT customer_unique_id FROM ({FACTS['export_dim_customers']})", "customer_unique_id"),
    "dim_region_performance": (f"SELECT customer_state FROM ({ITEMS['page_marketing_states']})", "customer_state"),
    "dim_payment_performance": (f"SELECT payment_type FROM ({FACTS['payment_mix']})", "payment_type"),
    "dim_product_performance": (f"SELECT product_id FROM ({ITEMS['export_dim_product']})", "product_id"),
    "dim_category_performance": (f"SELECT category FROM ({ITEMS['export_dim_category']})", "category"),
    "dim_seller_performance": (f"SELECT seller_id FROM ({ITEMS['export_dim_seller']})", "seller_id"),
    "dim_cohort_summary": (f"SELECT cohort_month FROM ({FACTS['cohort_summary']})", "cohort_month")}
_REFERENCES = [("fact_order_items[order_id]", "f2", "oid", "fact_orders"), ("fact_order_items[category]", "f2", "category", "dim_category_performance"),
               ("fact_orders[order_date]", "o", "day", "dim_date"), ("fact_orders[customer_state]", "o", "state", "dim_region_performance"),
               ("fact_orders[payment_type]", "o", "kind", "dim_payment_performance"), ("fact_orders[customer_unique_id]", "o", "who", "dim_customers_segmented"),
               ("fact_order_items[product_id]", "f2", "pid", "dim_product_performance"), ("fact_order_items[seller_id]", "f2", "sid", "dim_seller_performance"),
               ("fact_cohort_retention[cohort_month]", "cells", "cohort_month", "dim_cohort_summary")]
S["star_relationship_check"] = q(COH, "\nUNION ALL\n".join(f"""
SELECT '{name} -> {dim}[{_DIMENSIONS[dim][1]}]' AS foreign_key, count(*) FILTER (lost) AS orphans, count(*) AS rows_checked, round(100.0 * count(*) FILTER (lost) / count(*), 3) AS orphan_pct
FROM (SELECT {key} NOT IN ({_DIMENSIONS[dim][0]}) AS lost FROM {fact} WHERE {key} IS NOT NULL)""" for name, fact, key, dim in _REFERENCES))
_SURPLUS = "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {} GROUP BY {}))"
_FIGURES = [  # check, figure, figure that it has to equal
    ("No row inflation in item fact table", "(SELECT count(*) FROM lf)", "(SELECT count(*) FROM lineitem)"),
    ("No row inflation in order fact table", "(SELECT count(*) FROM off)", "(SELECT count(*) FROM orders)"),
    ("order_id is unique in fct_orders", _SURPLUS.format("off", "oid"), "0"),
    ("Revenue preserved exactly (item grain)", "(SELECT sum(price) FROM lf)", f"(SELECT sum({_PRICE}) FROM lineitem)"),
    ("Revenue preserved exactly (order grain)", "(SELECT sum(rev) FROM off)", f"(SELECT sum({_PRICE}) FROM lineitem)"),
    ("Every order has a customer_unique_id", "(SELECT count(*) FROM off WHERE who IS NULL)", "0"),
    ("Every item line has an English category", "(SELECT count(*) FROM lf WHERE english IS NULL)", "0"),
    ("One review per order", _SURPLUS.format("cr", "order_id"), "0"),
    ("One geolocation row per zip prefix", _SURPLUS.format("cg", "geolocation_zip_code_prefix"), "0"),
    ("No negative stage durations remain", "(SELECT count(*) FROM co WHERE approval_days < 0 OR carrier_days < 0 OR shipping_days < 0 OR delivery_days < 0)", "0"),
    ("No negative or zero prices", "(SELECT count(*) FROM ci WHERE price <= 0)", "0"),
    ("Customer count unchanged", "(SELECT count(DISTINCT customer_unique_id) FROM cc)", "(SELECT count(DISTINCT c_custkey) FROM customer)")]
_CLEAN = [f"{short} AS ({S['clean_' + name]})" for short, name in (
    ("co", "orders"), ("ci", "order_items"), ("cc", "customers"), ("cp", "products"), ("cs", "sellers"), ("cr", "reviews"), ("cg", "geolocation"))]
S["quality_validation_checks"] = q(*_CLEAN, """lf AS (
  SELECT ci.price, coalesce(cp.product_category_name_english, 'unknown') AS english FROM ci LEFT JOIN co USING (order_id) LEFT JOIN cc USING (customer_id)
  LEFT JOIN cp USING (product_id) LEFT JOIN cs USING (seller_id)),
off AS (
  SELECT co.order_id AS oid, cc.customer_unique_id AS who, coalesce(it.rev, 0) AS rev FROM co LEFT JOIN cc USING (customer_id)
  LEFT JOIN (SELECT order_id, sum(price) AS rev FROM ci GROUP BY order_id) it USING (order_id) LEFT JOIN cr USING (order_id))""", "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS "check", CASE WHEN {got} = {want} THEN 'PASS' ELSE 'FAIL' END AS result, {got} || ' == ' || {want} AS detail""" for n, got, want in _FIGURES))
_LADDER = f"""d AS (SELECT *, v - lag(v) OVER (PARTITION BY state ORDER BY i) AS d FROM tr),
e AS (SELECT *, lag(d) OVER (PARTITION BY state ORDER BY i) AS d0 FROM d),
p AS (SELECT state, arg_max(v, i) AS last, arg_max(d, i) AS ld, sum(d * d0) / sum(CASE WHEN d0 IS NOT NULL THEN d0 * d0 END) AS phi FROM e GROUP BY state),
allf AS (SELECT state, step, model, f FROM bf UNION ALL SELECT state, step, 'Simple exp smoothing', level FROM bs, range(1, 5) s(step)
  UNION ALL SELECT state, step, 'ARIMA(0, 1, 1)', level FROM b2, range(1, 5) s(step)
  UNION ALL SELECT state, step, 'ARIMA(1, 1, 0)', last + ld * (phi + CASE WHEN step >= 2 THEN pow(phi, 2) ELSE 0 END
    + CASE WHEN step >= 3 THEN pow(phi, 3) ELSE 0 END + CASE WHEN step >= 4 THEN pow(phi, 4) ELSE 0 END) FROM p, range(1, 5) s(step)),
sc AS (SELECT state, model, avg(abs(v - f)) AS mae, sqrt(avg(pow(v - f, 2))) AS rmse,
  CASE WHEN min(abs(v)) >= 1e-9 THEN avg(abs((v - f) / v)) * 100 END AS mape FROM allf JOIN te USING (state, step) GROUP BY ALL)"""
S["forecast_ladder_closed_form"] = recursive(
    TRAIN, _BASE_F, smoothing("tr", 100), smoothing("tr", 199).replace("RECURSIVE_MARK sm(", "RECURSIVE_MARK s2(").replace(" sm JOIN", " s2 sm JOIN")
    .replace("AS level FROM sm\n", "AS level FROM s2 sm\n").replace("bs AS (", "b2 AS ("), _LADDER, """
SELECT state AS series_id, model, round(mae, 4) AS "MAE", round(rmse, 4) AS "RMSE", round(mape, 4) AS "MAPE_pct",
  round(100.0 * mae / max(mae) FILTER (model = 'Naive (last value)') OVER (PARTITION BY state) - 100, 4) + CAST(0 AS DOUBLE) AS vs_naive_pct,
  row_number() OVER (PARTITION BY state ORDER BY round(mae, 4), model) AS rank FROM sc""")


# ---------------------------------------------------------------- trend and season
def _list(values: tuple) -> str:
    return "(SELECT unnest([" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "]) AS x)"


_A = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
_B = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)


def holt(source: str, name: str, phis: tuple) -> str:
    """Recursive Holt smoothing with the least-squares start; the best grid point per series as ``<name>b``."""
    return f"""RECURSIVE_MARK {name}(state, a, b, p, i, c, c1, c2, t, t1, t2, aa, ab, bb, ra, rb, sq) AS (
  SELECT state, a.x, b.x, p.x, CAST(0 AS BIGINT), 0e0, 1e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0
  FROM (SELECT DISTINCT state FROM {source}), {_list(_A)} a, {_list(_B)} b, {_list(phis)} p
  UNION ALL
  SELECT state, a, b, p, i + 1, c + u + a * e, (1 - a) * g1, (1 - a) * g2, u + a * b * e, u1 - a * b * g1, u2 - a * b * g2,
    aa + g1 * g1, ab + g1 * g2, bb + g2 * g2, ra + g1 * e, rb + g2 * e, sq + e * e
  FROM (SELECT *, v - c - u AS e, c1 + u1 AS g1, c2 + u2 AS g2
        FROM (SELECT h.*, s.v, t * p AS u, t1 * p AS u1, t2 * p AS u2 FROM {name} h JOIN {source} s ON s.state = h.state AND s.i = h.i + 1))),
{name}d AS (SELECT *, CASE WHEN aa * bb - ab * ab > 1e-10 * aa * bb THEN aa * bb - ab * ab END AS det FROM {name}
  WHERE i = (SELECT max(i) FROM {source} s WHERE s.state = {name}.state)),
{name}s AS (SELECT *, (ra * bb - rb * ab) / det AS l0, (aa * rb - ab * ra) / det AS b0 FROM {name}d),
{name}b AS (SELECT state, p, i AS n, c + c1 * l0 + c2 * b0 AS level, t + t1 * l0 + t2 * b0 AS trend FROM {name}s
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY sq - l0 * ra - b0 * rb, a, b, p) = 1)"""


def holt_winters(source: str, name: str, m: int) -> str:
    """Recursive damped Holt-Winters from the first two seasons."""
    return f"""{name}0 AS (SELECT state, avg(v) FILTER (i <= {m}) AS m1, avg(v) FILTER (i > {m}) AS m2, list(v ORDER BY i) FILTER (i <= {m}) AS f FROM {source} WHERE i <= {2 * m} GROUP BY state),
RECURSIVE_MARK {name}(state, a, b, p, g, i, l, t, z, sq) AS (
  SELECT state, a.x, b.x, p.x, g.x, CAST(0 AS BIGINT), m1, (m2 - m1) / {m}, list_transform(f, lambda q: q - m1), 0e0
  FROM {name}0, {_list(_A)} a, {_list(_B)} b, {_list((0.9, 0.98))} p, {_list((0.0, 0.05, 0.1, 0.2, 0.4))} g
  UNION ALL
  SELECT state, a, b, p, g, i + 1, l + u + a * e, u + a * b * e, list_append(z[2:], z[1] + g * e), sq + e * e
  FROM (SELECT *, v - l - u - z[1] AS e FROM (SELECT h.*, s.v, t * p AS u FROM {name} h JOIN {source} s ON s.state = h.state AND s.i = h.i + 1))),
{name}b AS (SELECT state, p, i AS n, l AS level, t AS trend, z FROM {name} WHERE i = (SELECT max(i) FROM {source} s WHERE s.state = {name}.state)
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY sq, a, b, p, g) = 1)"""


def holt_rows(horizon: int, m: int = 0) -> str:
    """(state, step, model, f) of the family; series that are too short have NULL."""
    ahead = "level + trend * list_sum(list_transform(range(1, step + 1), lambda j: pow(p, CAST(j AS DOUBLE))))"
    parts = [f"SELECT state, step, 'Holt (additive trend)' AS model, CASE WHEN n >= 4 THEN {ahead} END AS f FROM h1b, range(1, {horizon + 1}) s(step)",
             f"SELECT state, step, 'Holt (damped trend)', CASE WHEN n >= 4 THEN {ahead} END FROM h2b, range(1, {horizon + 1}) s(step)"]
    if m:
        parts.append(f"SELECT state, step, 'Holt-Winters (seasonal)', CASE WHEN n >= {2 * m} THEN {ahead} + z[(step - 1) % {m} + 1] END FROM h3b, range(1, {horizon + 1}) s(step)")
    return " UNION ALL ".join(parts)


_PHIS = (0.8, 0.85, 0.9, 0.94, 0.96, 0.98)
S["forecast_holt_family"] = recursive(TRAIN, holt("tr", "h1", (1.0,)), holt("tr", "h2", _PHIS), holt_winters("tr", "h3", 12), f"""
SELECT state AS series_id, model, CAST(step AS BIGINT) AS step, round(f, 2) AS forecast FROM ({holt_rows(4, 12)})""")


def ladder(base: str, more: str, horizon: int, extra: str = "") -> str:
    """The whole ladder over the CTEs tr and te."""
    several = smoothing("tr", 199).replace("RECURSIVE_MARK sm(", "RECURSIVE_MARK s2(").replace(" sm JOIN", " s2 sm JOIN").replace("AS level FROM sm\n", "AS level FROM s2 sm\n").replace("bs AS (", "b2 AS (")
    scored = _LADDER.replace("), sc AS (", "),\nsc AS (").replace("allf AS (", f"allf AS ({more} UNION ALL {extra}")
    scored = scored.replace("range(1, 5)", f"range(1, {horizon + 1})")
    if horizon > 4:
        a = scored.index("last + ld * ("); b = scored.index(" FROM p, range")
        scored = scored[:a] + "last + ld * list_sum(list_transform(range(1, step + 1), lambda j: pow(phi, CAST(j AS DOUBLE))))" + scored[b:]
    return recursive(base, _BASE_F.replace("range(1, 5)", f"range(1, {horizon + 1})"), smoothing("tr", 100), several, holt("tr", "h1", (1.0,)), holt("tr", "h2", _PHIS),
                     *([holt_winters("tr", "h3", 7)] if extra else []), scored, """
SELECT state AS series_id, model, round(mae, 4) AS "MAE", round(rmse, 4) AS "RMSE", round(mape, 4) AS "MAPE_pct",
  round(100.0 * mae / max(mae) FILTER (model = 'Naive (last value)') OVER (PARTITION BY state) - 100, 4) + CAST(0 AS DOUBLE) AS vs_naive_pct,
  row_number() OVER (PARTITION BY state ORDER BY round(mae, 4), model) AS rank FROM sc""")


S["forecast_ladder"] = ladder(TRAIN, holt_rows(4), 4)
_ALL_TRAIN = BASE + """, tr AS (SELECT 'all' AS state, mo, v, i, c - 4 AS n FROM al WHERE i <= c - 4), te AS (SELECT 'all' AS state, i - (c - 4) AS step, v FROM al WHERE i > c - 4)"""
S["export_forecast_models"] = ladder(_ALL + ", al4 AS (SELECT *, count(*) OVER () AS c FROM al)" + _ALL_TRAIN[len(BASE):].replace("FROM al ", "FROM al4 "), holt_rows(4), 4).replace(
    "SELECT state AS series_id, model, round(mae, 4)", "SELECT model, round(mae, 4)")
_DAY_ALL = BASE + """,
d1 AS (SELECT day, CAST(sum(rev) AS DOUBLE) AS v FROM o GROUP BY day),
d2 AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d1),
d3 AS (SELECT 'all' AS state, day AS mo, coalesce(v, 0) AS v, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS c FROM d2 LEFT JOIN d1 USING (day)),
tr AS (SELECT state, mo, v, i, c - 28 AS n FROM d3 WHERE i <= c - 28), te AS (SELECT state, i - (c - 28) AS step, v FROM d3 WHERE i > c - 28)"""
S["forecast_ladder_daily"] = ladder(_DAY_ALL, holt_rows(28, 7), 28, "SELECT state, step, 'Seasonal naive (7)', v FROM tr, range(1, 29) s(step) WHERE i = n - 7 + (step - 1) % 7 + 1 UNION ALL ")
S["page_forecast"] = " UNION ALL ".join(f"""SELECT 'history_and_forecast' AS dataset, period_label AS axis_value, '{name}' AS measure, round("{name}", 4) AS value
  FROM ({S['measures_forecast']})""" for name in ("Actual Revenue", "Forecast Revenue", "Forecast Lower 95", "Forecast Upper 95"))
S["page_forecast_cards"] = S["measure_next_month"]
S["page_forecast_models"] = f"SELECT model, MAE, RMSE, MAPE_pct, vs_naive_pct FROM ({S['export_forecast_models']})"
