"""The named query pack."""

from sqlcheck.base import F1, F2, PAY, REV, q

PACK: dict[str, str] = {}

PACK["monthly_revenue_and_growth"] = q(F2, """t AS (
  SELECT month, count(*) AS orders, count(DISTINCT who) AS customers, CAST(sum(rev) AS DOUBLE) AS revenue
  FROM po GROUP BY month),
u AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS prev FROM t)""", """
SELECT month AS order_month, orders, customers, revenue, round(revenue / orders, 2) AS aov,
  prev AS prev_month_revenue, round(100.0 * (revenue - prev) / prev, 2) AS mom_growth_pct,
  round(avg(revenue) OVER (ORDER BY month ROWS 2 PRECEDING), 2) AS revenue_3mo_moving_avg,
  round(sum(revenue) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS cumulative_revenue,
  round(100.0 * revenue / sum(revenue) OVER (), 2) AS pct_of_total_revenue
FROM u""")

PACK["yoy_growth_comparable_window"] = q(F2, """t AS (
  SELECT CAST(yr AS BIGINT) AS yr, count(*) AS orders, count(DISTINCT who) AS customers,
    CAST(sum(rev) AS DOUBLE) AS revenue FROM po WHERE month(day) <= 7 GROUP BY 1),
u AS (SELECT *, revenue / orders AS a, lag(revenue) OVER w AS r0, lag(orders) OVER w AS n0,
  lag(revenue / orders) OVER w AS a0 FROM t WINDOW w AS (ORDER BY yr))""", """
SELECT yr AS order_year, orders, customers, revenue, round(a, 2) AS aov,
  round(100.0 * (revenue - r0) / r0, 2) AS revenue_yoy_pct,
  round(CAST(100.0 * (orders - n0) AS DOUBLE) / n0, 2) AS orders_yoy_pct,
  round(100.0 * (a - a0) / a0, 2) AS aov_yoy_pct FROM u""")

PACK["quarterly_revenue_with_lead"] = q(F2, """t AS (
  SELECT quarter, count(*) AS orders, CAST(sum(rev) AS DOUBLE) AS revenue FROM po GROUP BY quarter),
u AS (SELECT *, lag(revenue) OVER (ORDER BY quarter) AS b, lead(revenue) OVER (ORDER BY quarter) AS n FROM t)""", """
SELECT quarter AS order_quarter, orders, revenue, b AS prev_quarter, n AS next_quarter,
  round(100.0 * (revenue - b) / b, 2) AS qoq_growth_pct,
  CASE quarter WHEN '2001Q3' THEN 'PARTIAL - Jul only, QoQ not comparable' ELSE 'complete' END AS data_completeness
FROM u""")

PACK["revenue_contribution_by_category"] = q(F2, """t AS (
  SELECT category, count(*) AS n, count(DISTINCT oid) AS orders, CAST(sum(rev) AS DOUBLE) AS revenue
  FROM f2 GROUP BY category),
u AS (SELECT *, sum(revenue) OVER () AS whole,
  100.0 * sum(revenue) OVER (ORDER BY revenue DESC, category ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () AS cum,
  rank() OVER (ORDER BY revenue DESC) AS k FROM t)""", """
SELECT k AS revenue_rank, category, orders, n AS items_sold, revenue, round(revenue / n, 2) AS avg_item_price,
  round(100.0 * revenue / whole, 2) AS pct_of_revenue, round(cum, 2) AS cumulative_pct,
  CASE WHEN cum <= 50 THEN 'top 50% of revenue' WHEN cum <= 80 THEN 'next 30%' ELSE 'long tail' END AS pareto_band
FROM u ORDER BY revenue DESC, category LIMIT 20""")

PACK["revenue_by_region"] = q(F2, """t AS (
  SELECT state, count(*) AS orders, count(DISTINCT who) AS customers, CAST(sum(rev) AS DOUBLE) AS revenue
  FROM po GROUP BY state),
u AS (SELECT *, revenue / orders AS a, sum(revenue) OVER () AS r, sum(orders) OVER () AS n FROM t)""", """
SELECT row_number() OVER (ORDER BY revenue DESC, state) AS revenue_rank, state AS customer_state, orders,
  customers, revenue, round(100.0 * revenue / r, 2) AS pct_of_revenue, round(a, 2) AS state_aov,
  round(r / n, 2) AS national_aov, round(a - r / n, 2) AS aov_vs_national,
  dense_rank() OVER (ORDER BY a DESC) AS aov_rank
FROM u ORDER BY revenue DESC, state LIMIT 15""")

PACK["monthly_revenue_by_top_category"] = q(F2, """t AS (
  SELECT category, month, CAST(sum(rev) AS DOUBLE) AS revenue FROM f2 GROUP BY ALL),
best AS (SELECT category FROM f2 GROUP BY category QUALIFY rank() OVER (ORDER BY sum(rev) DESC) <= 5),
u AS (SELECT *, lag(revenue) OVER w AS b, avg(revenue) OVER (w ROWS 2 PRECEDING) AS ma
  FROM t WHERE category IN (FROM best) AND month >= '2001-02'
  WINDOW w AS (PARTITION BY category ORDER BY month))""", """
SELECT category, month AS order_month, revenue, b AS prev_month, round(100.0 * (revenue - b) / b, 2) AS mom_pct,
  round(ma, 2) AS moving_avg_3mo FROM u""")

PACK["freight_burden_by_region"] = q(F2, """t AS (
  SELECT state, count(*) AS n, CAST(sum(rev) AS DOUBLE) AS revenue, CAST(sum(frt) AS DOUBLE) AS freight
  FROM f2 GROUP BY state HAVING count(*) >= 500)""", """
SELECT state AS customer_state, n AS item_lines, revenue, freight,
  round(100.0 * freight / revenue, 2) AS freight_pct_of_revenue, round(freight / n, 2) AS avg_freight_per_item,
  rank() OVER (ORDER BY freight / revenue DESC) AS freight_burden_rank FROM t""")

_VALUE = """v AS (
  SELECT who, count(*) AS orders, sum(rev) AS spend, min(day) AS d0, max(day) AS d1 FROM po GROUP BY who)"""

PACK["top_customers_ranked"] = q(F2, """t AS (
  SELECT who, state, count(*) AS orders, CAST(sum(rev) AS DOUBLE) AS spend, min(day) AS d0, max(day) AS d1
  FROM po GROUP BY who, state)""", """
SELECT row_number() OVER (ORDER BY spend DESC, who, state) AS row_number_rank,
  rank() OVER (ORDER BY orders DESC) AS rank_by_orders, dense_rank() OVER (ORDER BY orders DESC) AS dense_rank_by_orders,
  who AS customer_unique_id, state AS customer_state, orders, spend AS lifetime_spend,
  round(spend / orders, 2) AS aov, d0 AS first_purchase, d1 AS last_purchase,
  round(100.0 * spend / CAST(sum(CAST(spend AS DECIMAL(18,2))) OVER () AS DOUBLE), 4) AS pct_of_total_revenue
FROM t ORDER BY spend DESC, who, state LIMIT 20""")

PACK["repeat_vs_one_time"] = q(F2, _VALUE, """
SELECT CASE WHEN orders = 1 THEN 'one-time buyer' ELSE 'repeat buyer' END AS customer_type, count(*) AS customers,
  round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS pct_of_customers,
  CAST(sum(orders) AS BIGINT) AS total_orders, CAST(sum(spend) AS DOUBLE) AS total_revenue,
  round(100.0 * CAST(sum(spend) AS DOUBLE) / CAST(sum(sum(spend)) OVER () AS DOUBLE), 2) AS pct_of_revenue,
  round(CAST(sum(spend) AS DOUBLE) / count(*), 2) AS avg_lifetime_spend,
  round(CAST(sum(spend) AS DOUBLE) / sum(orders), 2) AS aov
FROM v GROUP BY 1""")

PACK["order_frequency_distribution"] = q(F1, """t AS (
  SELECT n, count(*) AS c FROM (SELECT who, count(*) AS n FROM f1 GROUP BY who) GROUP BY n)""", """
SELECT n AS orders_placed, c AS customers, round(100.0 * c / CAST(sum(c) OVER () AS DOUBLE), 3) AS pct_of_customers,
  CAST(sum(c) OVER (ORDER BY n) AS BIGINT) AS cumulative_customers,
  round(100.0 * CAST(sum(c) OVER (ORDER BY n) AS DOUBLE) / CAST(sum(c) OVER () AS DOUBLE), 3) AS cumulative_pct FROM t""")

PACK["first_and_last_purchase_per_customer"] = q(F1, """t AS (
  SELECT who, day, row_number() OVER w AS k, lag(day) OVER w AS b, count(*) OVER (PARTITION BY who) AS n,
    min(day) OVER (PARTITION BY who) AS d0, max(day) OVER (PARTITION BY who) AS d1
  FROM f1 WINDOW w AS (PARTITION BY who ORDER BY day, oid))""", """
SELECT who AS customer_unique_id, k AS purchase_seq, day AS order_date, b AS prev_order_date,
  datediff('day', b, day) AS days_since_prev_order, n AS total_orders, d0 AS first_purchase, d1 AS last_purchase,
  datediff('day', d1, DATE '2001-07-31') AS recency_days
FROM t WHERE n >= 3 ORDER BY n DESC, who, k LIMIT 25""")

PACK["repurchase_gap_summary"] = q(F1, """t AS (
  SELECT datediff('day', lag(day) OVER (PARTITION BY who ORDER BY day, oid), day) AS g FROM f1)""", """
SELECT count(g) AS repurchase_events, round(avg(g), 1) AS mean_gap_days, CAST(min(g) AS DOUBLE) AS min_gap_days,
  CAST(max(g) AS DOUBLE) AS max_gap_days, count(*) FILTER (g <= 30) AS within_30_days,
  count(*) FILTER (g <= 90) AS within_90_days, count(*) FILTER (g <= 180) AS within_180_days,
  round(100.0 * count(*) FILTER (g <= 90) / CAST(count(g) AS DOUBLE), 2) AS pct_within_90_days FROM t""")

NTILE_RFM = """s AS (
  SELECT who, datediff('day', d1, DATE '2001-08-01') AS rec, orders, spend,
    ntile(5) OVER (ORDER BY datediff('day', d1, DATE '2001-08-01') DESC, who) AS r,
    CASE WHEN orders >= 3 THEN 5 WHEN orders = 2 THEN 3 ELSE 1 END AS f,
    ntile(5) OVER (ORDER BY spend, who) AS m FROM v)"""
_RFM_OUT = """
SELECT who AS customer_unique_id, CAST(rec AS BIGINT) AS recency_days, orders AS frequency,
  CAST(spend AS DOUBLE) AS monetary, CAST(r AS BIGINT) AS r_score, CAST(f AS BIGINT) AS f_score,
  CAST(m AS BIGINT) AS m_score, r || '-' || f || '-' || m AS rfm_cell FROM s"""
PACK["customer_rfm_scores"] = q(F2, _VALUE, NTILE_RFM, _RFM_OUT + " ORDER BY spend DESC, who LIMIT 20")
PACK["ntile_rfm_all_customers"] = q(F2, _VALUE, NTILE_RFM, _RFM_OUT)

PACK["revenue_concentration_by_customer_decile"] = q(F2, _VALUE, """t AS (
  SELECT spend, ntile(10) OVER (ORDER BY spend DESC, who) AS k FROM v)""", """
SELECT CAST(k AS BIGINT) AS spend_decile, count(*) AS customers, CAST(sum(spend) AS DOUBLE) AS revenue,
  round(100.0 * CAST(sum(spend) AS DOUBLE) / CAST(sum(sum(spend)) OVER () AS DOUBLE), 2) AS pct_of_revenue,
  round(100.0 * CAST(sum(sum(spend)) OVER (ORDER BY k) AS DOUBLE) / CAST(sum(sum(spend)) OVER () AS DOUBLE), 2) AS cumulative_pct,
  round(CAST(sum(spend) AS DOUBLE) / count(*), 2) AS avg_spend, CAST(min(spend) AS DOUBLE) AS min_spend
FROM t GROUP BY k""")

PACK["new_vs_returning_by_month"] = q(F2, """t AS (
  SELECT month, rev, month = min(month) OVER (PARTITION BY who) AS fresh FROM po)""", """
SELECT month AS order_month, count(*) FILTER (fresh) AS new_customer_orders,
  count(*) FILTER (NOT fresh) AS returning_orders,
  CAST(coalesce(sum(rev) FILTER (fresh), 0) AS DOUBLE) AS new_revenue,
  CAST(coalesce(sum(rev) FILTER (NOT fresh), 0) AS DOUBLE) AS returning_revenue,
  round(100.0 * CAST(coalesce(sum(rev) FILTER (NOT fresh), 0) AS DOUBLE) / CAST(sum(rev) AS DOUBLE), 2) AS returning_revenue_pct
FROM t GROUP BY month""")

_PRODUCT = """p AS (
  SELECT pid, category, count(*) AS n, sum(rev) AS revenue, min(rev) AS lo, max(rev) AS hi FROM f2 GROUP BY ALL)"""

PACK["top_products_by_revenue"] = q(F2, _PRODUCT, """
SELECT row_number() OVER (ORDER BY revenue DESC, pid) AS overall_rank,
  dense_rank() OVER (PARTITION BY category ORDER BY revenue DESC) AS rank_in_category, pid AS product_id, category,
  n AS units_sold, CAST(revenue AS DOUBLE) AS revenue, round(CAST(revenue AS DOUBLE) / n, 2) AS avg_selling_price,
  CAST(lo AS DOUBLE) AS min_price, CAST(hi AS DOUBLE) AS max_price,
  round(100.0 * CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE), 3) AS pct_of_total_revenue
FROM p ORDER BY revenue DESC, pid LIMIT 20""")

PACK["worst_performing_products"] = q(F2, _PRODUCT, """
SELECT category, count(*) AS products_sold_once, CAST(sum(revenue) AS DOUBLE) AS revenue_from_them,
  round(CAST(sum(revenue) AS DOUBLE) / count(*), 2) AS avg_price,
  round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS pct_of_all_single_sale_products
FROM p WHERE n = 1 GROUP BY category ORDER BY products_sold_once DESC, category LIMIT 15""")

PACK["category_pareto_80_20"] = q(F2, """t AS (
  SELECT category, count(*) AS n, count(DISTINCT pid) AS products, CAST(sum(rev) AS DOUBLE) AS revenue
  FROM f2 GROUP BY category),
u AS (SELECT *, row_number() OVER w AS k, count(*) OVER () AS c, sum(revenue) OVER () AS whole,
  round(100.0 * sum(revenue) OVER (w ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER (), 2) AS cum
  FROM t WINDOW w AS (ORDER BY revenue DESC, category))""", """
SELECT k AS rank, category, products, n AS items_sold, revenue, round(100.0 * revenue / whole, 2) AS pct_of_revenue,
  cum AS cumulative_pct, round(100.0 * k / CAST(c AS DOUBLE), 2) AS pct_of_categories,
  CASE WHEN cum <= 80 THEN 'within first 80% of revenue' ELSE 'tail' END AS pareto_side
FROM u WHERE k <= 25""")

PACK["category_price_and_volume_quadrant"] = q(F2, """t AS (
  SELECT category, count(*) AS n, CAST(sum(rev) AS DOUBLE) AS revenue, round(CAST(sum(rev) AS DOUBLE) / count(*), 2) AS price
  FROM f2 GROUP BY category HAVING count(*) >= 500),
u AS (SELECT *, median(price) OVER () AS mp, median(n) OVER () AS mn FROM t)""", """
SELECT category, n AS units, revenue, price AS avg_price, round(mp, 2) AS median_category_price,
  round(CAST(mn AS DOUBLE), 0) AS median_category_units,
  CASE WHEN price >= mp THEN 'premium' ELSE 'budget' END || CASE WHEN n >= mn THEN ' + high volume' ELSE ' + low volume' END
    || CASE WHEN price >= mp AND n >= mn THEN ' (protect)' WHEN price >= mp THEN ' (grow reach)'
            WHEN n >= mn THEN ' (traffic driver)' ELSE ' (review)' END AS quadrant
FROM u ORDER BY revenue DESC, category LIMIT 25""")

PACK["price_band_analysis"] = q(F2, """t AS (
  SELECT CASE WHEN rev < 1000 THEN 'a. under R$1000' WHEN rev < 5000 THEN 'b. R$1000-5000'
    WHEN rev < 20000 THEN 'c. R$5000-20000' WHEN rev < 40000 THEN 'd. R$20000-40000'
    WHEN rev < 60000 THEN 'e. R$40000-60000' WHEN rev < 90000 THEN 'f. R$60000-90000' ELSE 'g. R$90000+' END AS band,
    count(*) AS n, CAST(sum(rev) AS DOUBLE) AS revenue FROM f2 GROUP BY 1)""", """
SELECT band AS price_band, n AS item_lines, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 2) AS pct_of_lines,
  revenue, round(100.0 * revenue / sum(revenue) OVER (), 2) AS pct_of_revenue, round(revenue / n, 2) AS avg_price FROM t""")

PACK["category_monthly_momentum"] = q(F2, """t AS (
  SELECT category, CAST(coalesce(sum(rev) FILTER (month IN ('2001-05', '2001-06', '2001-07')), 0) AS DOUBLE) AS b,
    CAST(coalesce(sum(rev) FILTER (month IN ('2001-02', '2001-03', '2001-04')), 0) AS DOUBLE) AS a
  FROM f2 GROUP BY category)""", """
SELECT category, a AS revenue_feb_apr_2001, b AS revenue_may_jul_2001, round(b - a, 2) AS change_brl,
  round(100.0 * (b - a) / a, 2) AS change_pct, rank() OVER (ORDER BY round(b - a, 2) DESC) AS momentum_rank
FROM t WHERE a > 20000""")

PACK["seller_concentration"] = q(F2, """t AS (
  SELECT sid, seller_state, count(DISTINCT oid) AS orders, count(*) AS n, count(DISTINCT pid) AS products,
    CAST(sum(rev) AS DOUBLE) AS revenue FROM f2 GROUP BY ALL)""", """
SELECT row_number() OVER w AS seller_rank, sid AS seller_id, seller_state, orders, n AS items, products, revenue,
  round(100.0 * revenue / sum(revenue) OVER (), 3) AS pct_of_revenue,
  round(100.0 * sum(revenue) OVER (w ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER (), 2) AS cumulative_pct
FROM t WINDOW w AS (ORDER BY revenue DESC, sid) ORDER BY revenue DESC, sid LIMIT 20""")

_SCORED = REV + ", sc AS (SELECT oid, score FROM review)"

PACK["payment_method_performance"] = q(F2, PAY, _SCORED, """t AS (
  SELECT kind, count(*) AS n, CAST(sum(rev) AS DOUBLE) AS revenue, avg(inst) AS i, avg(score) AS s
  FROM po JOIN dom USING (oid) LEFT JOIN sc USING (oid) GROUP BY kind)""", """
SELECT kind AS payment_type, n AS orders, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 2) AS pct_of_orders, revenue,
  round(100.0 * revenue / sum(revenue) OVER (), 2) AS pct_of_revenue, round(revenue / n, 2) AS aov,
  round(i, 2) AS avg_installments, round(s, 3) AS avg_review_score, rank() OVER (ORDER BY revenue / n DESC) AS aov_rank
FROM t""")

PACK["installment_behaviour"] = q(F2, PAY, _SCORED, """card AS (
  SELECT oid, max(inst) AS i FROM vpay WHERE kind = 'credit_card' GROUP BY oid),
t AS (
  SELECT CASE WHEN i = 1 THEN 'a. paid in full (1x)' WHEN i IN (2, 3) THEN 'b. 2-3x' WHEN i IN (4, 5, 6) THEN 'c. 4-6x'
    WHEN i IN (7, 8, 9, 10) THEN 'd. 7-10x' ELSE 'e. 11x or more' END AS band, count(*) AS n,
    CAST(sum(rev) AS DOUBLE) AS revenue, avg(score) AS s
  FROM po JOIN card USING (oid) LEFT JOIN sc USING (oid) GROUP BY 1)""", """
SELECT band AS installment_band, n AS orders, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 2) AS pct_of_orders,
  round(revenue / n, 2) AS aov, revenue, round(s, 3) AS avg_review_score FROM t""")

PACK["regional_performance_scorecard"] = q(F2, _SCORED, """a AS (
  SELECT state, count(*) AS n, avg(dd) AS d, avg(CAST(late AS INT)) AS l, avg(score) AS s
  FROM f1 LEFT JOIN sc USING (oid) GROUP BY state HAVING count(*) >= 100),
b AS (SELECT state, CAST(sum(rev) AS DOUBLE) AS revenue, CAST(sum(frt) AS DOUBLE) AS freight FROM f2 GROUP BY state)""", """
SELECT state AS customer_state, n AS orders, revenue, round(revenue / n, 2) AS aov,
  round(100.0 * freight / revenue, 2) AS freight_pct_of_revenue, round(d, 1) AS avg_delivery_days,
  round(100.0 * l, 2) AS late_rate_pct, round(s, 3) AS avg_review_score,
  rank() OVER (ORDER BY revenue DESC) AS revenue_rank, rank() OVER (ORDER BY revenue / n DESC) AS aov_rank,
  rank() OVER (ORDER BY d) AS speed_rank FROM a JOIN b USING (state)""")

PACK["seller_performance_proxy"] = q(F2, _SCORED, """svc AS (
  SELECT sid, avg(dd) AS d, avg(CAST(late AS INT)) AS l, avg(score) AS s
  FROM (SELECT DISTINCT sid, oid, dd, late FROM f2) LEFT JOIN sc USING (oid) GROUP BY sid),
r AS (
  SELECT sid, seller_state, count(*) AS n, count(DISTINCT oid) AS orders, count(DISTINCT pid) AS products,
    CAST(sum(rev) AS DOUBLE) AS revenue FROM f2 GROUP BY ALL)""", """
SELECT row_number() OVER (ORDER BY revenue DESC, sid) AS rank, sid AS seller_id, seller_state, orders, products, revenue,
  round(revenue / n, 2) AS avg_item_price, round(100.0 * revenue / sum(revenue) OVER (), 3) AS pct_of_revenue,
  round(d, 1) AS avg_delivery_days, round(100.0 * l, 2) AS late_rate_pct, round(s, 3) AS avg_review_score
FROM r JOIN svc USING (sid) ORDER BY revenue DESC, sid LIMIT 20""")

PACK["category_mix_by_region"] = q(F2, """t AS (
  SELECT state, category, CAST(sum(rev) AS DOUBLE) AS revenue, count(DISTINCT oid) AS orders FROM f2 GROUP BY ALL),
u AS (SELECT *, sum(revenue) OVER (PARTITION BY state) AS whole FROM t
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY revenue DESC, category) = 1)""", """
SELECT state AS customer_state, category AS top_category, revenue AS category_revenue, orders,
  round(100.0 * revenue / whole, 2) AS pct_of_state_revenue, round(whole, 2) AS state_total_revenue
FROM u WHERE whole > 100000""")

PACK["delivery_experience_vs_repeat"] = q(F1, _SCORED, """t AS (
  SELECT late, dd, score, count(*) OVER (PARTITION BY who) AS n FROM f1 LEFT JOIN sc USING (oid)
  QUALIFY row_number() OVER (PARTITION BY who ORDER BY day, oid) = 1)""", """
SELECT CASE WHEN late THEN 'first order was LATE' ELSE 'first order on time' END AS first_experience,
  count(*) AS customers, count(*) FILTER (n > 1) AS came_back,
  round(100.0 * count(*) FILTER (n > 1) / CAST(count(*) AS DOUBLE), 3) AS repeat_rate_pct,
  round(avg(score), 3) AS avg_review_score, round(avg(dd), 1) AS avg_delivery_days FROM t GROUP BY 1""")
