"""Facts, customers, cohorts and metrics."""

from sqlcheck.base import F1, F2, FACT, even_share, q

S: dict[str, str] = {}

BASE = FACT + f""",
o AS (SELECT *, round_even(dd, 2) AS days, round_even(v_days, 2) AS versus,
  CASE WHEN n_items > 0 THEN {even_share('rev', 'n_items')} END AS unit_price,
  day > DATE '2001-07-23' AS cut FROM fo)"""

FEAT = BASE + """,
feat0 AS (
  SELECT who, min(bought) AS t0, max(bought) AS t1, count(*) AS n, sum(rev) AS spend, sum(frt) AS frt,
    CAST(sum(n_items) AS BIGINT) AS items, avg(score) AS score, count(*) FILTER (late) AS late_n, avg(days) AS dd,
    min(state) AS state FROM o GROUP BY who),
feat AS (
  SELECT *, datediff('day', t1, TIMESTAMP '2001-08-01') AS rec, datediff('day', t0, TIMESTAMP '2001-08-01') AS ten,
    CAST(spend AS DOUBLE) / n AS aov, n > 1 AS rep, CAST(late_n AS DOUBLE) / n AS late_rate
  FROM feat0 LEFT JOIN (SELECT who, count(DISTINCT pid) AS n_prod, count(DISTINCT category) AS n_cat,
    count(DISTINCT sid) AS n_sell FROM f2 GROUP BY who) USING (who)),
gap AS (
  SELECT (epoch_us(bought) - lag(epoch_us(bought)) OVER (PARTITION BY who ORDER BY bought, oid)) / 86400e6 AS g FROM o)"""

RISK = FEAT + """,
lim AS (SELECT (SELECT quantile_cont(g, 0.9) FROM gap) AS lapse,
  (SELECT quantile_cont(CAST(spend * 100 AS DOUBLE), 0.8) FROM feat) AS high),
risk AS (
  SELECT feat.*, rec > lapse AS lapsed,
    CASE WHEN rec <= 90 THEN '1. Active (bought in last 90d)' WHEN rec <= lapse THEN '2. Cooling (90d - lapse threshold)'
      WHEN CAST(spend * 100 AS DOUBLE) >= high THEN '3. Lapsed - HIGH value (priority win-back)' ELSE '4. Lapsed - low value' END AS tier
  FROM feat, lim),
mq AS (SELECT quantile_cont(CAST(spend * 100 AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e,
  quantile_cont(CAST(spend * 100 AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS d,
  quantile_cont(CAST(rec AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS r FROM feat),
scored AS (
  SELECT risk.*, 5 - len(list_filter(mq.r, lambda x: rec > x)) AS r_score,
    CASE WHEN n >= 3 THEN 5 WHEN n = 2 THEN 3 ELSE 1 END AS f_score,
    1 + len(list_filter(mq.e, lambda x: CAST(spend * 100 AS DOUBLE) > x)) AS m_score,
    1 + len(list_filter(mq.d, lambda x: CAST(spend * 100 AS DOUBLE) > x)) AS decile
  FROM risk, mq),
seg AS (
  SELECT *, r_score || '-' || f_score || '-' || m_score AS cell,
    CASE WHEN f_score = 5 AND r_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN f_score = 5 AND r_score >= 3 THEN 'Loyal'
      WHEN f_score = 5 THEN 'At Risk' WHEN r_score >= 4 AND m_score >= 4 THEN 'Potential Loyalists'
      WHEN r_score >= 4 THEN 'New Customers' WHEN r_score = 3 THEN 'Needs Attention' WHEN m_score >= 4 THEN 'At Risk'
      ELSE 'Lost' END AS segment
  FROM scored)"""


def _money(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _share(expr: str, digits: int = 4) -> str:
    return f"round(100.0 * CAST({expr} AS DOUBLE) / CAST(sum({expr}) OVER () AS DOUBLE), {digits})"


MEAN_REV = "round(CAST(sum(rev) AS DOUBLE) / count(*), 4)"

S["view_analysis_orders"] = q(F1, """
SELECT oid AS order_id, month AS order_month, quarter AS order_quarter, CAST(yr AS INT) AS order_year, day AS order_date,
  dow AS order_dow, dd AS delivery_days, late AS is_late, who AS customer_id, who AS customer_unique_id, state AS customer_state,
  'customer ' || lpad(CAST(who AS VARCHAR), 9, '0') || ' ' || lower(c_mktsegment) AS customer_city
FROM f1 JOIN customer ON c_custkey = who""")

S["view_analysis_items"] = q(F2, """
SELECT oid AS order_id, ln AS order_item_id, pid AS product_id, sid AS seller_id, CAST(rev AS DECIMAL(18,2)) AS revenue,
  frt AS freight_value, category, seller_state, month AS order_month, quarter AS order_quarter, CAST(yr AS INT) AS order_year,
  day AS order_date, dow AS order_dow, dd AS delivery_days, late AS is_late, who AS customer_id, who AS customer_unique_id,
  state AS customer_state, 'customer ' || lpad(CAST(who AS VARCHAR), 9, '0') || ' ' || lower(c_mktsegment) AS customer_city
FROM f2 JOIN customer ON c_custkey = who""")

S["export_fact_orders"] = q(BASE, """
SELECT oid AS order_id, who AS customer_unique_id, day AS order_date, bought AS order_timestamp, CAST(yr AS BIGINT) AS order_year,
  month AS order_month, quarter AS order_quarter, dow AS order_weekday, CAST(hour(bought) AS BIGINT) AS order_hour,
  CAST(rev AS DECIMAL(18,2)) AS revenue, CAST(frt AS DECIMAL(18,2)) AS freight, n_items AS items_in_order,
  n_prod AS distinct_products, n_sell AS distinct_sellers, unit_price AS avg_item_price, n_items > 1 AS is_multi_item,
  kind AS payment_type, CAST(max_inst AS BIGINT) AS max_installments, CAST(score AS BIGINT) AS review_score, days AS delivery_days,
  CAST(30 AS DOUBLE) AS estimated_days, versus AS delivery_vs_estimate_days, late AS is_late, state AS customer_state,
  'customer ' || lpad(CAST(who AS VARCHAR), 9, '0') || ' ' || lower(c_mktsegment) AS customer_city, cut AS is_truncated_period
FROM o JOIN customer ON c_custkey = who""")

S["export_fact_order_items"] = q(F2, """
SELECT oid AS order_id, CAST(ln AS BIGINT) AS order_item_id, pid AS product_id, sid AS seller_id, who AS customer_unique_id,
  day AS order_date, month AS order_month, quarter AS order_quarter, category, CAST(rev AS DECIMAL(18,2)) AS revenue,
  frt AS freight, state AS customer_state, seller_state, state = seller_state AS same_state_delivery,
  CAST(yr AS BIGINT) AS order_year, bought AS order_timestamp FROM f2""")

S["kpis"] = q(BASE, """
SELECT CAST(sum(rev) AS DOUBLE) AS revenue, count(*) AS orders, count(DISTINCT who) AS customers,
  round(CAST(sum(rev) AS DOUBLE) / count(*), 4) AS aov_mean, round(median(CAST(rev AS DOUBLE)), 4) AS aov_median,
  CAST(sum(frt) AS DOUBLE) AS freight, round(CAST(sum(n_items) AS DOUBLE) / count(*), 4) AS items_per_order,
  round(avg(CAST(late AS INT)), 4) AS late_rate, round(avg(score), 4) AS avg_review,
  round(avg(CAST(score = 1 AS INT)), 4) AS one_star_rate,
  (SELECT round(avg(CAST(n > 1 AS INT)), 4) FROM (SELECT count(*) AS n FROM o GROUP BY who)) AS repeat_rate FROM o""")

_FILTER = """o2 AS (SELECT * FROM o WHERE yr IN (1997, 1998) AND state IN ('NATION_1', 'NATION_2', 'NATION_3')
  AND kind IN ('credit_card', 'boleto') AND bought >= TIMESTAMP '1997-03-01' AND bought < TIMESTAMP '1998-11-01')"""
S["filtered_kpis"] = S["kpis"].replace("\nSELECT CAST(sum(rev)", ",\n" + _FILTER + "\nSELECT CAST(sum(rev)").replace(
    "FROM o GROUP BY who", "FROM o2 GROUP BY who").replace("AS repeat_rate FROM o", "AS repeat_rate FROM o2")

S["metric_monthly_revenue"] = q(BASE, """t AS (
  SELECT month, CAST(sum(rev) AS DOUBLE) AS revenue, count(*) AS orders, count(DISTINCT who) AS customers
  FROM o WHERE NOT cut GROUP BY month),
u AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS b FROM t)""", """
SELECT month, revenue, orders, customers, round(revenue / orders, 4) AS aov, month = '2001-07' AS partial_month,
  CASE WHEN month <> '2001-07' THEN round(100.0 * (revenue - b) / b, 4) END AS mom_pct FROM u""")

_STATE = f"""SELECT state, {_money('sum(rev)')} AS revenue, count(*) AS orders, {MEAN_REV} AS aov,
  round(avg(CAST(late AS INT)), 4) AS late_rate, round(avg(score), 4) AS avg_review, {_share('sum(rev)')} AS revenue_pct
FROM o GROUP BY state"""
S["metric_revenue_by_state"] = q(BASE, _STATE)
S["highest_and_lowest_state"] = q(BASE, f"t AS ({_STATE})", """
SELECT arg_max(state, (aov, state)) AS highest, max(aov) AS highest_value, arg_min(state, (aov, state)) AS lowest,
  min(aov) AS lowest_value FROM t""")

S["payment_mix"] = q(BASE, f"""
SELECT kind AS payment_type, count(*) AS orders, {_money('sum(rev)')} AS revenue, {MEAN_REV} AS aov,
  round(avg(score), 4) AS avg_review, round(avg(max_inst), 4) AS avg_installments, round(avg(n_items), 4) AS avg_items,
  {_share('count(*)')} AS order_pct, {_share('sum(rev)')} AS revenue_pct, round(median(CAST(rev AS DOUBLE)), 4) AS median_value
FROM o WHERE kind IS NOT NULL GROUP BY kind""")

S["instalment_curve"] = q(BASE, f"""
SELECT CAST(max_inst AS BIGINT) AS installments, count(*) AS orders, {MEAN_REV} AS aov, round(avg(score), 4) AS avg_review
FROM o WHERE kind = 'credit_card' GROUP BY 1 HAVING count(*) >= 30""")

S["instalment_bands"] = q(BASE, """t AS (
  SELECT *, CASE WHEN max_inst <= 0 THEN NULL WHEN max_inst <= 1 THEN '1x (paid in full)' WHEN max_inst <= 3 THEN '2-3x'
    WHEN max_inst <= 6 THEN '4-6x' WHEN max_inst <= 10 THEN '7-10x' WHEN max_inst <= 100 THEN '11x+' END AS band
  FROM o WHERE kind = 'credit_card')""", f"""
SELECT band AS installment_band, count(*) AS orders_n, {MEAN_REV} AS aov, {_money('sum(rev)')} AS revenue,
  round(avg(score), 4) AS avg_review, round(avg(n_items), 4) AS avg_items, {_share('count(*)')} AS pct_of_orders,
  round(median(CAST(rev AS DOUBLE)), 4) AS median_value FROM t WHERE band IS NOT NULL GROUP BY band""")

_REGION = f"""reg AS (
SELECT state AS customer_state, count(*) AS orders, count(DISTINCT who) AS customers, {_money('sum(rev)')} AS revenue,
  {MEAN_REV} AS aov, round(avg(days), 4) AS avg_delivery_days, round(avg(score), 4) AS avg_review_score,
  round(100.0 * avg(CAST(late AS INT)), 4) AS late_rate_pct,
  round(100.0 * CAST(sum(frt) AS DOUBLE) / CAST(sum(rev) AS DOUBLE), 4) AS freight_pct_of_revenue,
  {_share('sum(rev)')} AS pct_of_revenue FROM o GROUP BY state)"""
S["region_scorecard"] = q(BASE, _REGION, "SELECT * FROM reg WHERE orders >= 100")
S["region_correlations"] = q(BASE, _REGION, """
SELECT count(*) AS states, round(corr(avg_delivery_days, aov), 6) AS days_vs_aov,
  round(corr(avg_delivery_days, avg_review_score), 6) AS days_vs_review,
  round(corr(freight_pct_of_revenue, aov), 6) AS freight_vs_aov FROM reg WHERE orders >= 100""")

S["basket_bands"] = q(BASE, f"""
SELECT n_items AS items_in_order, count(*) AS orders, {MEAN_REV} AS mean_value, round(avg(unit_price), 4) AS mean_item_price,
  {_share('count(*)')} AS pct, round(median(CAST(rev AS DOUBLE)), 4) AS median_value FROM o GROUP BY n_items""")

S["value_drivers"] = q(BASE, """r AS (
  SELECT n_items AS n, CAST(rev AS DOUBLE) AS v, unit_price AS p FROM o),
k AS (SELECT (rank() OVER (ORDER BY n) + rank() OVER (ORDER BY n) + count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn,
  rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv FROM r),
k2 AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp,
  rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv FROM r WHERE p IS NOT NULL)""", """
SELECT round(corr(n, v), 6) AS items_pearson, round(corr(p, v), 6) AS price_pearson, round(corr(n, p), 6) AS items_vs_price,
  round(100.0 * regr_r2(v, n), 4) AS items_r2_pct, round(100.0 * regr_r2(v, p), 4) AS price_r2_pct,
  (SELECT round(corr(rn, rv), 6) FROM k) AS items_spearman, (SELECT round(corr(rp, rv), 6) FROM k2) AS price_spearman FROM r""")

S["weekday_table"] = q(BASE, f"""
SELECT CAST(isodow(day) AS BIGINT) AS weekday_number, dow AS weekday, count(*) AS orders_n, {_money('sum(rev)')} AS revenue,
  {MEAN_REV} AS aov FROM o GROUP BY ALL""")

S["busiest_days"] = q(BASE, """t AS (SELECT day, count(*) AS n, CAST(sum(rev) AS DOUBLE) AS r FROM o GROUP BY day)""", """
SELECT day AS order_date, n AS orders_n, r AS revenue, round(n / (SELECT median(n) FROM t), 4) AS orders_vs_median,
  round(r / (SELECT median(r) FROM t), 4) AS revenue_vs_median FROM t ORDER BY n DESC, day LIMIT 6""")

S["around_event"] = q(BASE, """t AS (SELECT
  CAST(coalesce(sum(rev) FILTER (day >= DATE '1998-11-17' AND day < DATE '1998-11-24'), 0) AS DOUBLE) AS b,
  CAST(coalesce(sum(rev) FILTER (day = DATE '1998-11-24'), 0) AS DOUBLE) AS e,
  CAST(coalesce(sum(rev) FILTER (day > DATE '1998-11-24' AND day <= DATE '1998-12-01'), 0) AS DOUBLE) AS a FROM o)""", """
SELECT b AS before, e AS event_day, a AS after, round(100.0 * (a - b) / b, 4) AS change_pct FROM t""")

S["like_for_like_months"] = q(BASE, """t AS (
  SELECT month, count(*) FILTER (day(day) <= 21) AS n, CAST(coalesce(sum(rev) FILTER (day(day) <= 21), 0) AS DOUBLE) AS r,
    CAST(sum(rev) AS DOUBLE) AS raw FROM o WHERE month BETWEEN '2001-02' AND '2001-07' GROUP BY month)""", """
SELECT month, n AS orders, r AS revenue_days_1_21, raw AS raw_month_total, round(r / 21, 4) AS revenue_per_day,
  round(r / n, 4) AS aov, round(100.0 * (r - lag(r) OVER (ORDER BY month)) / lag(r) OVER (ORDER BY month), 4) AS mom_pct FROM t""")

S["reviews_by_lateness"] = q(BASE, """
SELECT CASE WHEN late THEN 'late' ELSE 'on time / early' END AS delivery, count(*) AS orders, round(avg(score), 4) AS mean_score,
  round(100.0 * avg(CAST(score = 1 AS INT)), 4) AS one_star_rate, round(100.0 * avg(CAST(score = 5 AS INT)), 4) AS five_star_rate
FROM o WHERE score IS NOT NULL GROUP BY 1""")

S["delivery_by_score"] = q(BASE, """
SELECT CAST(score AS BIGINT) AS review_score, count(*) AS orders, round(avg(days), 4) AS mean_days,
  round(100.0 * avg(CAST(late AS INT)), 4) AS late_rate, round(median(days), 4) AS median_days
FROM o WHERE score IS NOT NULL GROUP BY score""")

S["estimate_padding"] = q(BASE, """
SELECT CASE WHEN late THEN 'late' ELSE 'on time / early' END AS delivery, count(*) AS orders,
  round(avg(versus), 4) AS mean_days_vs_estimate, CAST(30 AS DOUBLE) AS mean_promised_days
FROM o WHERE versus IS NOT NULL GROUP BY 1""")

S["order_value_profile"] = q(BASE, """t AS (SELECT CAST(rev AS DOUBLE) AS v FROM o),
w AS (SELECT CAST(count(*) AS DOUBLE) AS "count", round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS "min",
  max(v) AS "max", round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.25), 4) AS p25,
  round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90,
  round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99 FROM t)""", """
SELECT statistic, value FROM w UNPIVOT (value FOR statistic IN ("count", mean, std, "min", "max", p10, p25, p50, p75, p90, p95, p99))""")

S["order_value_below_mean"] = q(BASE, """
SELECT round(100.0 * avg(CAST(CAST(rev AS DOUBLE) < (SELECT CAST(sum(rev) AS DOUBLE) / count(*) FROM o) AS INT)), 4) AS below_mean_pct FROM o""")

S["distribution_shape"] = q(BASE, """t AS (
  SELECT 'revenue' AS c, CAST(rev AS DOUBLE) AS v FROM o UNION ALL SELECT 'freight', CAST(frt AS DOUBLE) FROM o
  UNION ALL SELECT 'items_in_order', CAST(n_items AS DOUBLE) FROM o)""", """
SELECT c AS "column", count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(skewness(v), 4) AS skew,
  round(kurtosis(v), 4) AS kurtosis FROM t GROUP BY c""")

S["payment_value_counts"] = q(BASE, f"SELECT kind AS payment_type, count(*) AS n, {_share('count(*)')} AS pct FROM o GROUP BY kind")

S["repurchase_gap_table"] = q(FEAT, """d AS (SELECT unnest([7, 30, 60, 90, 180, 365]) AS d)""", """
SELECT CAST(d AS BIGINT) AS within_days, (SELECT count(*) FROM gap WHERE g <= d.d) AS events,
  round(100.0 * (SELECT count(*) FROM gap WHERE g <= d.d) / CAST((SELECT count(g) FROM gap) AS DOUBLE), 4) AS pct_of_repurchases FROM d""")

S["repurchase_gap_distribution"] = q(FEAT, """
SELECT count(g) AS events, round(avg(g), 4) AS mean_days, round(min(g), 4) AS min_days, round(max(g), 4) AS max_days,
  round(quantile_cont(g, 0.25), 4) AS p25_days, round(quantile_cont(g, 0.5), 4) AS p50_days,
  round(quantile_cont(g, 0.75), 4) AS p75_days, round(quantile_cont(g, 0.9), 4) AS p90_days FROM gap""")
S["lapse_threshold"] = q(FEAT, "SELECT round(quantile_cont(g, 0.9), 4) AS lapse_days FROM gap")

FIRST = BASE + """,
fst AS (SELECT who, count(*) AS n, count(*) > 1 AS back, arg_min(late, (bought, oid)) AS late,
  arg_min(score, (bought, oid)) FILTER (score IS NOT NULL) AS score,
  arg_min(days, (bought, oid)) FILTER (days IS NOT NULL) AS days FROM o GROUP BY who)"""
S["first_experience_by_lateness"] = q(FIRST, """
SELECT CASE WHEN late THEN 'first order LATE' ELSE 'first order on time' END AS first_experience, count(*) AS customers,
  count(*) FILTER (back) AS came_back, round(100.0 * avg(CAST(back AS INT)), 4) AS repeat_rate,
  round(avg(score), 4) AS avg_review, round(avg(days), 4) AS avg_delivery FROM fst GROUP BY 1""")
S["first_experience_by_score"] = q(FIRST, """
SELECT CAST(score AS BIGINT) AS review_score, count(*) AS customers, round(100.0 * avg(CAST(back AS INT)), 4) AS repeat_rate
FROM fst WHERE score IS NOT NULL GROUP BY score""")

COH = BASE + """,
pm AS (SELECT who, yr * 12 + month(day) AS mi, count(*) AS n, sum(rev) AS rev FROM o GROUP BY ALL),
c AS (SELECT *, min(mi) OVER (PARTITION BY who) AS co, mi - min(mi) OVER (PARTITION BY who) AS age FROM pm),
lab AS (SELECT *, printf('%d-%02d', CAST((co - 1) // 12 AS INT), CAST((co - 1) % 12 + 1 AS INT)) AS cohort_month FROM c),
cells AS (SELECT cohort_month, co, CAST(age AS BIGINT) AS age, count(DISTINCT who) AS customers, sum(rev) AS rev FROM lab GROUP BY ALL),
size AS (SELECT co, customers AS cohort_size, rev AS rev0 FROM cells WHERE age = 0)"""
_RET = """SELECT cohort_month, age, customers, cohort_size, round(100.0 * customers / CAST(cohort_size AS DOUBLE), 4) AS retention_pct
FROM cells JOIN size USING (co)"""
S["retention_matrix"] = q(COH, _RET)
S["retention_pivot"] = q(COH, f"r AS ({_RET})", "SELECT cohort_month, " + ", ".join(
    f"max(retention_pct) FILTER (age = {k}) AS m{k}" for k in range(67)) + " FROM r GROUP BY cohort_month")
S["retention_curve"] = q(COH, """
SELECT age AS month, round(avg(100.0 * customers / CAST(cohort_size AS DOUBLE)), 4) AS retention_pct, count(*) AS cohorts
FROM cells JOIN size USING (co) WHERE age > 0 GROUP BY age""")
S["retention_curve_zero_filled"] = q(COH, """sp AS (
  SELECT co, cohort_size, unnest(generate_series(1, 2001 * 12 + 7 - co)) AS age FROM size WHERE co < 2001 * 12 + 7)""", """
SELECT CAST(sp.age AS BIGINT) AS month, round(avg(coalesce(100.0 * customers / CAST(cohort_size AS DOUBLE), 0)), 4) AS retention_pct,
  count(*) AS cohorts FROM sp LEFT JOIN cells ON cells.co = sp.co AND cells.age = sp.age GROUP BY sp.age""")
_SUM = """ppl AS (SELECT cohort_month, co, who, sum(rev) AS rev, bool_or(age BETWEEN 1 AND 3) AS w, max(age) > 0 AS e, sum(n) AS n
  FROM lab GROUP BY ALL),
csum AS (
  SELECT cohort_month, count(*) AS new_customers, CAST(sum(rev) AS DOUBLE) AS revenue,
    round(CAST(sum(rev) AS DOUBLE) / count(*), 4) AS revenue_per_customer,
    CASE WHEN 2001 * 12 + 7 - co >= 3 THEN round(100.0 * count(*) FILTER (w) / CAST(count(*) AS DOUBLE), 4) END AS repeat_rate_3mo_pct,
    round(100.0 * count(*) FILTER (e) / CAST(count(*) AS DOUBLE), 4) AS ever_repeated_pct,
    CAST(2001 * 12 + 7 - co AS BIGINT) AS months_observed FROM ppl GROUP BY cohort_month, co)"""
S["cohort_summary"] = q(COH, _SUM, "SELECT * FROM csum")
_FAIR = """fair AS (SELECT cohort_month, count(*) AS cohort_size, count(*) FILTER (w) AS repeated_within_horizon,
  round(100.0 * count(*) FILTER (w) / CAST(count(*) AS DOUBLE), 4) AS repeat_rate_pct FROM ppl WHERE 2001 * 12 + 7 - co >= 3 GROUP BY 1)"""
S["cohort_fair_comparison"] = q(COH, _SUM, _FAIR, "SELECT * FROM fair")
S["cohort_fair_trend"] = q(COH, _SUM, _FAIR, """x AS (
  SELECT repeat_rate_pct AS y, CAST(row_number() OVER (ORDER BY cohort_month) - 1 AS DOUBLE) AS i, count(*) OVER () AS n FROM fair)""", """
SELECT count(*) AS cohorts, round(avg(y), 4) AS mean_pct, round(regr_slope(y, i), 6) AS slope_pp_per_cohort,
  round(regr_intercept(y, i), 6) AS intercept_pct, round(avg(y) FILTER (i < 6), 4) AS early_mean_pct,
  round(avg(y) FILTER (i >= n - 6), 4) AS late_mean_pct FROM x""")
S["cohort_censoring"] = q(COH, _SUM, """x AS (
  SELECT 100.0 * count(*) FILTER (n > 1) / CAST(count(*) AS DOUBLE) AS r, CAST(2001 * 12 + 7 - co AS DOUBLE) AS m FROM ppl GROUP BY co)""", """
SELECT count(*) AS cohorts, round(avg(r), 4) AS mean_rate_pct, round(corr(m, r), 6) AS correlation, round(regr_slope(r, m), 6) AS slope FROM x""")
S["cohort_revenue_retention"] = q(COH, """
SELECT cohort_month, age, CAST(rev AS DOUBLE) AS revenue, round(100.0 * CAST(rev AS DOUBLE) / CAST(rev0 AS DOUBLE), 4) AS pct_of_month_0
FROM cells JOIN size USING (co)""")
S["cohort_later_revenue"] = q(COH, """t AS (
  SELECT CAST(coalesce(sum(rev) FILTER (age = 0), 0) AS DOUBLE) AS a, CAST(coalesce(sum(rev) FILTER (age > 0), 0) AS DOUBLE) AS b FROM c)""", """
SELECT a AS first_month_revenue, b AS later_revenue, round(100.0 * b / (a + b), 4) AS later_share_pct FROM t""")

# ---------------------------------------------------------------- customers
S["customer_features"] = q(FEAT, """
SELECT who AS customer_unique_id, t0 AS first_order, t1 AS last_order, n AS frequency, CAST(spend AS DECIMAL(18,2)) AS monetary,
  CAST(frt AS DECIMAL(18,2)) AS total_freight, items AS total_items, round(score, 4) AS avg_review, late_n AS late_orders,
  round(dd, 4) AS avg_delivery_days, state, n_prod AS n_distinct_products, n_cat AS n_categories, n_sell AS n_sellers,
  rec AS recency, ten AS tenure, round(aov, 4) AS aov, rep AS is_repeat, round(late_rate, 4) AS late_rate FROM feat""")
_MS = "round(CAST(sum(spend) AS DOUBLE) / count(*), 4)"
S["customer_risk_tiers"] = q(RISK, f"""
SELECT tier AS risk_tier, count(*) AS customers, {_money('sum(spend)')} AS revenue, {_MS} AS avg_spend,
  round(avg(rec), 4) AS avg_recency, round(100.0 * avg(CAST(rep AS INT)), 4) AS repeat_rate, {_share('count(*)')} AS pct_of_customers,
  {_share('sum(spend)')} AS pct_of_revenue FROM risk GROUP BY tier""")
S["customer_lapse_status"] = q(RISK, f"""
SELECT CASE WHEN rep AND lapsed THEN 'repeat, lapsed' WHEN rep THEN 'repeat, still active' WHEN lapsed THEN 'one-time, lapsed'
    ELSE 'one-time, still within window' END AS status, count(*) AS customers, {_money('sum(spend)')} AS revenue, {_MS} AS avg_spend,
  round(avg(rec), 4) AS avg_recency, {_share('count(*)')} AS pct_of_customers, {_share('sum(spend)')} AS pct_of_revenue
FROM risk GROUP BY 1""")
S["customer_value_deciles"] = q(RISK, f"""
SELECT CAST(decile AS BIGINT) AS value_decile, count(*) AS customers, {_money('sum(spend)')} AS revenue, {_money('min(spend)')} AS min_spend,
  {_money('max(spend)')} AS max_spend, {_MS} AS avg_spend, round(100.0 * avg(CAST(rep AS INT)), 4) AS repeat_rate,
  {_share('sum(spend)')} AS pct_of_revenue, round(100.0 * CAST(sum(sum(spend)) OVER (ORDER BY decile DESC) AS DOUBLE)
    / CAST(sum(sum(spend)) OVER () AS DOUBLE), 4) AS cumulative_pct FROM scored GROUP BY decile""")
_CURVE = """k AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS i, count(*) OVER () AS n,
  100.0 * CAST(sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) AS cum FROM vals)"""
_POINTS = """
SELECT CAST(p AS BIGINT) AS top_pct, round((SELECT cum FROM k WHERE i = greatest(n * p // 100, 1)), 4) AS pct_of_amount
FROM (SELECT unnest([1, 5, 10, 20, 50]) AS p)"""
S["customer_concentration"] = q(FEAT, "vals AS (SELECT spend AS v FROM feat)", _CURVE, _POINTS)
S["seller_revenue_concentration"] = q(F2, "vals AS (SELECT sum(rev) AS v FROM f2 GROUP BY sid)", _CURVE, _POINTS)
S["customer_geography"] = q(FEAT, f"""
SELECT state, count(*) AS customers, {_money('sum(spend)')} AS revenue, {_MS} AS avg_spend,
  round(100.0 * avg(CAST(rep AS INT)), 4) AS repeat_rate, round(avg(score), 4) AS avg_review, round(avg(dd), 4) AS avg_delivery,
  round(100.0 * avg(late_rate), 4) AS late_rate, {_share('sum(spend)')} AS pct_of_revenue,
  round(median(CAST(spend AS DOUBLE)), 4) AS median_spend FROM feat GROUP BY state""")
S["customer_frequency_table"] = q(FEAT, f"""
SELECT n AS frequency, count(*) AS customers, {_money('sum(spend)')} AS revenue, {_share('count(*)')} AS pct_of_customers,
  {_share('sum(spend)')} AS pct_of_revenue FROM feat GROUP BY n""")
S["customer_repeat_comparison"] = q(FEAT, f"""
SELECT CASE WHEN rep THEN 'repeat buyers' ELSE 'one-time buyers' END AS buyers, count(*) AS customers,
  {_money('sum(spend)')} AS revenue, {_MS} AS avg_lifetime_spend, round(avg(aov), 4) AS avg_order_value,
  round(avg(score), 4) AS avg_review_score, {_share('count(*)')} AS pct_of_customers, {_share('sum(spend)')} AS pct_of_revenue
FROM feat GROUP BY 1""")
S["rfm_scores"] = q(RISK, """
SELECT who AS customer_unique_id, rec AS recency, n AS frequency, CAST(spend AS DOUBLE) AS monetary, CAST(r_score AS BIGINT) AS r_score,
  CAST(f_score AS BIGINT) AS f_score, CAST(m_score AS BIGINT) AS m_score, cell AS rfm_cell,
  CAST(r_score + f_score + m_score AS BIGINT) AS rfm_sum, segment AS rfm_segment FROM seg""")
S["rfm_segment_profile"] = q(RISK, f"""
SELECT segment AS rfm_segment, count(*) AS customers, {_money('sum(spend)')} AS revenue, round(avg(rec), 4) AS avg_recency,
  round(avg(n), 4) AS avg_frequency, {_MS} AS avg_monetary, round(avg(aov), 4) AS avg_aov, round(avg(score), 4) AS avg_review,
  round(100.0 * avg(CAST(rep AS INT)), 4) AS repeat_rate, {_share('count(*)')} AS pct_of_customers, {_share('sum(spend)')} AS pct_of_revenue
FROM seg GROUP BY segment""")
S["rfm_score_bands"] = q(RISK, """
SELECT CAST(r_score AS BIGINT) AS r_score, CAST(min(rec) AS DOUBLE) AS recency_min, CAST(max(rec) AS DOUBLE) AS recency_max,
  count(*) AS customers FROM seg GROUP BY r_score""")
S["rfm_score_grid"] = q(RISK, "SELECT CAST(r_score AS BIGINT) AS r_score, " + ", ".join(
    f"CAST(coalesce(sum(spend) FILTER (m_score = {k}), 0) AS DOUBLE) AS m_{k}" for k in range(1, 6)) + " FROM seg GROUP BY r_score")
S["rfm_frequency_crosstab"] = q(RISK, """
SELECT segment AS rfm_segment, CAST(f_score AS BIGINT) AS f_score, count(*) AS n,
  round(100.0 * count(*) / CAST(sum(count(*)) OVER (PARTITION BY segment) AS DOUBLE), 4) AS row_pct FROM seg GROUP BY segment, f_score""")
S["agreement_segment_decile"] = q(RISK, """ct AS (SELECT segment AS a, decile AS b, CAST(count(*) AS DOUBLE) AS n FROM seg GROUP BY ALL),
ra AS (SELECT a, sum(n) AS n FROM ct GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM ct GROUP BY b), t AS (SELECT sum(n) AS n FROM ct),
p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS c, (SELECT sum(n * (n - 1) / 2) FROM ra) AS x,
  (SELECT sum(n * (n - 1) / 2) FROM rb) AS y, (SELECT n * (n - 1) / 2 FROM t) AS w,
  (SELECT sum(ct.n / t.n * ln(ct.n * t.n / (ra.n * rb.n))) FROM ct JOIN ra USING (a) JOIN rb USING (b), t) AS mi,
  (SELECT -sum(ra.n / t.n * ln(ra.n / t.n)) FROM ra, t) AS ha, (SELECT -sum(rb.n / t.n * ln(rb.n / t.n)) FROM rb, t) AS hb)""", """
SELECT round((c - x * y / w) / ((x + y) / 2 - x * y / w), 6) AS adjusted_rand_index, round(mi / ((ha + hb) / 2), 6) AS normalised_mutual_information FROM p""")
S["cluster_feature_matrix"] = q(FEAT, """f AS (SELECT who, CAST(rec AS DOUBLE) AS r, ln(1 + CAST(n AS DOUBLE)) AS f,
  ln(1 + CAST(spend AS DOUBLE)) AS m, ln(1 + aov) AS a, ln(1 + CAST(n_cat AS DOUBLE)) AS c FROM feat)""", """
SELECT who AS customer_unique_id, """ + ", ".join(
    f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 5) AS {name}" for c, name in zip(
        "rfmac", ["recency", "frequency", "monetary", "aov", "n_categories"])) + " FROM f")
S["cluster_decomposition"] = q(FEAT, """f AS (SELECT CAST(rec AS DOUBLE) AS r, ln(1 + CAST(n AS DOUBLE)) AS f,
  ln(1 + CAST(spend AS DOUBLE)) AS m, ln(1 + aov) AS a, ln(1 + CAST(n_cat AS DOUBLE)) AS c FROM feat),
z AS (SELECT """ + ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}" for c in "rfmac") + """ FROM f)""", """
SELECT k, count(*) AS customers, round(sum(""" + " + ".join(f"{c} * {c}" for c in "rfmac") + """), 1) AS total_squares
FROM z, (SELECT unnest(range(2, 9)) AS k) GROUP BY k""")
DIM = RISK + f""",
dim AS (
  SELECT who AS customer_unique_id, state AS customer_state, CAST(t0 AS DATE) AS first_order_date, CAST(t1 AS DATE) AS last_order_date,
    rec AS recency_days, n AS frequency_orders, CAST(spend AS DECIMAL(18,2)) AS monetary_revenue, {even_share('spend', 'n')} AS avg_order_value,
    items AS total_items, n_cat AS distinct_categories, n_sell AS distinct_sellers, ten AS tenure_days,
    round_even(score, 3) AS avg_review_score, late_n AS late_orders, rep AS is_repeat_customer, CAST(r_score AS BIGINT) AS r_score,
    CAST(f_score AS BIGINT) AS f_score, CAST(m_score AS BIGINT) AS m_score, cell AS rfm_cell, segment AS rfm_segment,
    CAST(decile AS BIGINT) AS value_decile, tier AS risk_tier FROM seg)"""
S["export_dim_customers"] = q(DIM, "SELECT * FROM dim")
_CS = """
SELECT count(*) AS customers, count(*) FILTER (is_repeat_customer) AS repeat_customers,
  round(avg(CAST(is_repeat_customer AS INT)), 4) AS repeat_rate, CAST(sum(monetary_revenue) AS DOUBLE) AS revenue,
  round(CAST(sum(monetary_revenue) AS DOUBLE) / count(*), 4) AS avg_value, round(avg(recency_days), 4) AS avg_recency_days,
  round(median(CAST(monetary_revenue AS DOUBLE)), 4) AS median_value FROM dim"""
S["customers_summary"] = q(DIM, _CS)
_SEGS = " WHERE rfm_segment IN ('Champions', 'Loyal', 'At Risk')"
S["filtered_customers_summary"] = q(DIM, _CS + _SEGS)
S["filtered_customers_by_state"] = q(DIM, _CS + " WHERE customer_state IN ('NATION_2', 'NATION_5')")
S["filtered_customers_by_risk"] = q(DIM, _CS + " WHERE risk_tier LIKE '3.%'")
S["customer_segments"] = q(DIM, f"""
SELECT rfm_segment AS segment, count(*) AS customers, {_money('sum(monetary_revenue)')} AS revenue,
  round(avg(recency_days), 4) AS avg_recency_days, round(avg(frequency_orders), 4) AS avg_orders,
  round(CAST(sum(monetary_revenue) AS DOUBLE) / count(*), 4) AS avg_value, {_share('count(*)')} AS customer_pct,
  {_share('sum(monetary_revenue)')} AS revenue_pct FROM dim GROUP BY 1""")
S["metric_top_customers"] = q(DIM, """
SELECT customer_unique_id, customer_state, rfm_segment, risk_tier, frequency_orders, monetary_revenue, avg_order_value,
  recency_days, distinct_categories FROM dim ORDER BY monetary_revenue DESC, customer_unique_id LIMIT 20""")
_COHF = DIM + COH[len(BASE):].replace("FROM o GROUP BY ALL", f"FROM o WHERE who IN (SELECT customer_unique_id FROM dim{_SEGS}) GROUP BY ALL")
S["filtered_retention_curve"] = q(_COHF, """
SELECT age AS month, round(avg(100.0 * customers / CAST(cohort_size AS DOUBLE)), 4) AS retention_pct, count(*) AS cohorts
FROM cells JOIN size USING (co) WHERE age > 0 GROUP BY age""")
S["filtered_cohort_summary"] = q(_COHF, _SUM, "SELECT * FROM csum")
S["measures_customers"] = q(DIM, """
SELECT risk_tier, count(*) AS "Segment Customers", CAST(sum(monetary_revenue) AS DOUBLE) AS "Segment Revenue",
  count(*) FILTER (is_repeat_customer) AS "Repeat Customers", round(avg(CAST(is_repeat_customer AS INT)), 6) AS "Repeat Rate %",
  round(CAST(sum(monetary_revenue) AS DOUBLE) / count(*), 6) AS "Avg Customer Value" FROM dim GROUP BY risk_tier""")
S["measure_segment_revenue_share"] = q(DIM, """
SELECT rfm_segment, CAST(sum(monetary_revenue) AS DOUBLE) AS "Segment Revenue", round(CAST(sum(monetary_revenue) AS DOUBLE)
  / CAST((SELECT sum(monetary_revenue) FROM dim) AS DOUBLE), 6) AS "Segment Revenue %" FROM dim WHERE risk_tier LIKE '3%' GROUP BY 1""")
