"""Item, product and category metrics, exports, measures and tests."""

from sqlcheck.base import F2, even_share, q
from sqlcheck.facts import S as FACTS
from sqlcheck.facts import _CURVE, _FILTER, _REGION, BASE, COH, DIM, FIRST, _money, _share

S: dict[str, str] = {}

_AVG = "round(CAST(sum(rev) AS DOUBLE) / count(*), 4)"
PRIOR, RECENT = "('2001-02', '2001-03', '2001-04')", "('2001-05', '2001-06', '2001-07')"

S["metric_revenue_by_category"] = q(F2, f"""t AS (
  SELECT category, {_money('sum(rev)')} AS revenue, count(*) AS items, count(DISTINCT oid) AS orders, {_AVG} AS avg_price,
    {_share('sum(rev)')} AS revenue_pct FROM f2 GROUP BY category)""", "SELECT * FROM t ORDER BY revenue DESC, category LIMIT 15")

_PROD = """pr AS (SELECT pid, sum(rev) AS v, count(*) AS n FROM f2 GROUP BY pid), vals AS (SELECT v FROM pr)"""
_PARETO = """
SELECT (SELECT count(*) FROM pr) AS products, least((SELECT count(*) FROM k WHERE cum <= 80) + 1, (SELECT count(*) FROM pr)) AS products_for_80pct,
  round(100.0 * least((SELECT count(*) FROM k WHERE cum <= 80) + 1, (SELECT count(*) FROM pr)) / CAST((SELECT count(*) FROM pr) AS DOUBLE), 4) AS pct_of_products_for_80pct,
  round((SELECT cum FROM k WHERE i = greatest(n * 1 // 100, 1)), 4) AS top_1pct_revenue_share,
  (SELECT round(100.0 * count(*) FILTER (n = 1) / CAST(count(*) AS DOUBLE), 4) FROM pr) AS sold_once_pct,
  (SELECT round(100.0 * CAST(coalesce(sum(v) FILTER (n = 1), 0) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 4) FROM pr) AS sold_once_revenue_pct"""
_SUMMARY = """,
  (SELECT CAST(sum(rev) AS DOUBLE) FROM f2) AS revenue, (SELECT count(*) FROM f2) AS items_sold,
  (SELECT round(CAST(sum(rev) AS DOUBLE) / count(*), 4) FROM f2) AS avg_item_price,
  (SELECT count(DISTINCT category) FROM f2) AS categories"""
S["product_pareto"] = q(F2, _PROD, _CURVE, _PARETO)
S["product_summary"] = q(F2, _PROD, _CURVE, _PARETO + _SUMMARY)
S["product_pareto_curve"] = q(F2, _PROD, _CURVE, """
SELECT CAST(p AS BIGINT) AS pct_products, round((SELECT cum FROM k WHERE i = greatest(n * p // 100, 1)), 3) AS pct_revenue
FROM (SELECT unnest(generate_series(1, 100)) AS p)""")

_QUAD = """q0 AS (SELECT category, CAST(sum(rev) AS DOUBLE) AS revenue, count(*) AS units_sold,
  CAST(sum(rev) AS DOUBLE) / count(*) AS price FROM f2 GROUP BY category HAVING count(*) >= 500),
qd AS (SELECT *, CASE WHEN price >= (SELECT median(price) FROM q0) THEN 'Premium' ELSE 'Budget' END ||
  CASE WHEN units_sold >= (SELECT median(units_sold) FROM q0) THEN ' + high volume' ELSE ' + low volume' END AS quadrant FROM q0)"""
_SLICE = """f2x AS (SELECT f2.* FROM f2 JOIN dom USING (oid) WHERE yr IN (1997, 1998) AND kind = 'credit_card'
  AND seller_state IN ('NATION_1', 'NATION_4', 'NATION_7', 'NATION_11')
  AND category IN (SELECT category FROM qd WHERE quadrant LIKE '%high volume'))"""
S["filtered_product_summary"] = q(BASE, _QUAD, _SLICE, _PROD.replace("FROM f2", "FROM f2x"), _CURVE,
                                  _PARETO + _SUMMARY.replace("FROM f2", "FROM f2x"))
_CAT = f"""ct AS (
  SELECT category, {_money('sum(rev)')} AS revenue, count(*) AS units, count(DISTINCT oid) AS orders, count(DISTINCT pid) AS products,
    {_AVG} AS avg_item_price, {_share('sum(rev)')} AS pct_of_revenue,
    round(100.0 * CAST(sum(frt) AS DOUBLE) / CAST(sum(rev) AS DOUBLE), 4) AS freight_pct_of_revenue,
    CAST(coalesce(sum(rev) FILTER (month IN {PRIOR}), 0) AS DOUBLE) AS a,
    CAST(coalesce(sum(rev) FILTER (month IN {RECENT}), 0) AS DOUBLE) AS b FROM f2 GROUP BY category)"""
_CATX = """SELECT ct.* EXCLUDE (a, b), a AS revenue_feb_apr_2001, b AS revenue_may_jul_2001, round(b - a, 2) AS momentum_change_brl,
  round(100.0 * round(b - a, 2) / nullif(a, 0), 4) AS momentum_change_pct"""
S["category_table"] = q(F2, _QUAD, _CAT, _CATX + ", quadrant FROM ct LEFT JOIN qd USING (category)")
S["momentum_extremes"] = q(F2, _CAT, f"m AS ({_CATX} FROM ct)", """
SELECT DISTINCT category, momentum_change_brl, momentum_change_pct FROM (
  (FROM m WHERE revenue_feb_apr_2001 > 0 OR revenue_may_jul_2001 > 0 ORDER BY momentum_change_brl DESC, category LIMIT 8) UNION ALL
  (FROM m WHERE revenue_feb_apr_2001 > 0 OR revenue_may_jul_2001 > 0 ORDER BY momentum_change_brl, category LIMIT 8))""")
S["metric_top_products"] = q(F2, f"""t AS (
  SELECT pid, category, count(*) AS n, {_money('sum(rev)')} AS v, count(DISTINCT sid) AS s, {_AVG} AS p FROM f2 GROUP BY ALL)""", """
SELECT pid AS product_id, category, n AS units, v AS revenue, s AS sellers, p AS avg_item_price,
  row_number() OVER w AS revenue_rank, round(100.0 * sum(v) OVER (w ROWS UNBOUNDED PRECEDING) / sum(v) OVER (), 4) AS cumulative_pct_of_revenue
FROM t WINDOW w AS (ORDER BY v DESC, pid, category) ORDER BY revenue_rank LIMIT 20""")
S["price_volume_quadrants"] = q(F2, _QUAD, """
SELECT category, revenue, units_sold, round(price, 4) AS avg_selling_price, quadrant FROM qd""")
S["quadrant_profile"] = q(F2, _QUAD, f"""
SELECT quadrant, count(*) AS categories, round(sum(revenue), 2) AS revenue, CAST(sum(units_sold) AS BIGINT) AS units,
  round(avg(price), 4) AS avg_price, {_share('sum(revenue)')} AS revenue_pct FROM qd GROUP BY quadrant""")
_MOM = "mo AS (SELECT category, a, b, round(b - a, 2) AS change FROM ct WHERE a > 20000)"
S["momentum_summary"] = q(F2, _CAT, _MOM, """
SELECT count(*) FILTER (change > 0) AS growing, count(*) FILTER (change < 0) AS declining,
  round(coalesce(sum(change) FILTER (change > 0), 0), 2) AS gained, round(coalesce(sum(change) FILTER (change < 0), 0), 2) AS lost,
  round(sum(change), 2) AS net_change FROM mo""")
S["category_freight_burden"] = q(F2, """t AS (SELECT category, count(*) AS n, CAST(sum(rev) AS DOUBLE) AS r, CAST(sum(frt) AS DOUBLE) AS f
  FROM f2 GROUP BY category HAVING count(*) >= 500)""", """
SELECT category, n AS units_sold, round(r / n, 4) AS avg_selling_price, r AS revenue, f AS freight,
  round(100.0 * f / r, 4) AS freight_pct_of_revenue, round((SELECT corr(r / n, 100.0 * f / r) FROM t), 6) AS price_freight_correlation FROM t""")
S["premium_routes"] = q(F2, """t AS (SELECT pid, any_value(category) AS category, count(*) AS n, CAST(sum(rev) AS DOUBLE) AS v,
  round(CAST(sum(rev) AS DOUBLE) / count(*) * 1000000) AS p FROM f2 GROUP BY pid)""", """
SELECT pid AS product_id, category, n AS units_sold, round(v / n, 4) AS avg_selling_price, v AS revenue,
  CASE WHEN p > (SELECT quantile_cont(p, 0.95) FROM t) THEN 'premium (few units, high price)' ELSE 'volume (many units, low price)' END AS route
FROM t ORDER BY v DESC, pid LIMIT 10""")
S["regional_mix"] = q(F2, """t AS (SELECT category, CAST(sum(rev) AS DOUBLE) AS a, CAST(sum(rev) FILTER (state = 'NATION_1') AS DOUBLE) AS h
  FROM f2 GROUP BY category),
u AS (SELECT category, 100.0 * h / sum(h) OVER () AS h, 100.0 * a / sum(a) OVER () AS n FROM t)""", """
SELECT category, round(h, 4) AS state_pct, round(n, 4) AS national_pct, round(h - n, 4) AS pp_vs_national FROM u WHERE h IS NOT NULL""")
S["export_dim_category"] = q(F2, _QUAD, _CAT, _MOM, """x AS (SELECT category, round(median(CAST(rev AS DOUBLE)), 4) AS median_price,
  CAST(sum(frt) AS DOUBLE) AS freight, CAST(sum(rev) AS DOUBLE) / count(*) AS p FROM f2 GROUP BY category)""", """
SELECT category, ct.revenue, units, orders, products, round(p, 2) AS avg_item_price, median_price, freight, pct_of_revenue,
  round(100.0 * sum(ct.revenue) OVER (ORDER BY ct.revenue DESC, category ROWS UNBOUNDED PRECEDING) / sum(ct.revenue) OVER (), 4) AS cumulative_pct_of_revenue,
  coalesce(quadrant, 'Low volume (<500 units)') AS quadrant, mo.a AS revenue_feb_apr_2001, mo.b AS revenue_may_jul_2001,
  change AS momentum_change_brl, round(100.0 * (mo.b - mo.a) / mo.a, 4) AS momentum_change_pct,
  round(100.0 * freight / ct.revenue, 2) AS freight_pct_of_revenue
FROM ct JOIN x USING (category) LEFT JOIN qd USING (category) LEFT JOIN mo USING (category)""")
S["export_dim_product"] = q(F2, """t AS (SELECT pid, any_value(category) AS category, count(*) AS n, count(DISTINCT oid) AS orders, sum(rev) AS v,
  min(rev) AS lo, max(rev) AS hi, CAST(sum(frt) AS DOUBLE) AS f, count(DISTINCT sid) AS s FROM f2 GROUP BY pid)""", f"""
SELECT pid AS product_id, category, n AS units, orders, CAST(v AS DOUBLE) AS revenue, {even_share("v", "n")} AS avg_item_price,
  CAST(lo AS DOUBLE) AS min_price, CAST(hi AS DOUBLE) AS max_price, round(f, 2) AS freight, s AS sellers, row_number() OVER w AS revenue_rank,
  round(100.0 * CAST(sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 3) AS cumulative_pct_of_revenue,
  n = 1 AS sold_once_only FROM t WINDOW w AS (ORDER BY v DESC, pid)""")

_SELL = f"""svc AS (SELECT sid, seller_state, sum(rev) AS v, CAST(sum(items) AS BIGINT) AS items_sold, count(*) AS orders_n,
  round(avg(days), 4) AS avg_delivery_days, round(100.0 * avg(CAST(late AS INT)), 4) AS late_rate_pct, round(avg(score), 4) AS avg_review_score
  FROM (SELECT sid, seller_state, oid, sum(rev) AS rev, count(*) AS items FROM f2 GROUP BY ALL) p
  JOIN (SELECT oid, days, late, score FROM o) USING (oid) GROUP BY ALL),
sl AS (SELECT svc.*, b.products, round(CAST(v AS DOUBLE) / items_sold, 4) AS avg_item_price, {_share('v')} AS pct_of_revenue
  FROM svc JOIN (SELECT sid, count(DISTINCT pid) AS products FROM f2 GROUP BY sid) b USING (sid))"""
S["seller_scorecard"] = q(BASE, _SELL, """
SELECT sid AS seller_id, seller_state, CAST(v AS DOUBLE) AS revenue, items_sold, orders_n, avg_delivery_days, late_rate_pct,
  avg_review_score, products, pct_of_revenue FROM sl WHERE orders_n >= 5 ORDER BY v DESC, sid LIMIT 20""")
S["late_sellers"] = q(BASE, _SELL, "big AS (SELECT * FROM sl WHERE orders_n >= 20)", """
SELECT sid AS seller_id, seller_state, CAST(v AS DOUBLE) AS revenue, orders_n, late_rate_pct, avg_delivery_days, avg_review_score,
  round((SELECT corr(late_rate_pct, avg_review_score) FROM big), 6) AS late_review_correlation
FROM big ORDER BY late_rate_pct DESC, sid LIMIT 8""")
S["export_dim_seller"] = q(BASE, _SELL, """
SELECT sid AS seller_id, seller_state, CAST(v AS DOUBLE) AS revenue, items_sold, orders_n, products, avg_item_price, avg_delivery_days,
  late_rate_pct, avg_review_score, pct_of_revenue, row_number() OVER w AS revenue_rank,
  round(100.0 * CAST(sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 3) AS cumulative_pct_of_revenue
FROM sl WINDOW w AS (ORDER BY v DESC, sid)""")
S["top_category_per_state"] = q(F2, """t AS (SELECT state, category, sum(rev) AS v FROM f2 GROUP BY ALL)""", """
SELECT state AS customer_state, category, CAST(v AS DOUBLE) AS revenue,
  round(100.0 * CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY state) AS DOUBLE), 4) AS pct_of_state
FROM t WHERE state IN (SELECT state FROM f1 GROUP BY state HAVING count(*) >= 100)
QUALIFY row_number() OVER (PARTITION BY state ORDER BY v DESC, category DESC) = 1""")
S["filter_domains"] = q(BASE, "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS filter, CAST({c} AS VARCHAR) AS value, CAST(sum(rev) AS DOUBLE) AS amount FROM {t} WHERE {c} IS NOT NULL GROUP BY 2"""
    for name, c, t in (("order_year", "yr", "o"), ("customer_state", "state", "o"), ("payment_type", "kind", "o"),
                       ("category", "category", "f2"), ("seller_state", "seller_state", "f2"))))
_ASKED = (("customer_state", "state", "o", ("NATION_1", "NATION_24", "nation_1", "ATLANTIS")), ("order_year", "yr", "o", ("1997", "1850")),
          ("seller_state", "seller_state", "f2", ("NATION_3", "")))
S["filter_requested_values"] = q(BASE, "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS filter, '{v}' AS value, (SELECT count(*) FROM {t} WHERE CAST({c} AS VARCHAR) = '{v}') > 0 AS known"""
    for name, c, t, values in _ASKED for v in values))
S["filter_date_domain"] = q(BASE, "SELECT min(day) AS date_min, max(day) AS date_max FROM o")
_DATE = """dd AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS d FROM o)"""
S["export_dim_date"] = q(BASE, _DATE, """
SELECT d AS date, year(d) AS year, year(d) || 'Q' || quarter(d) AS quarter, strftime(d, '%Y-%m') AS month,
  strftime(d, '%b %Y') AS month_name, day(d) AS day_of_month, dayname(d) AS weekday, isodow(d) AS weekday_number,
  isodow(d) >= 6 AS is_weekend, d > DATE '2001-07-23' AS is_truncated_period FROM dd""")
S["star_revenue_by_calendar"] = q(BASE, """
SELECT CAST(yr AS BIGINT) AS year, isodow(day) >= 6 AS is_weekend, CAST(sum(rev) AS DOUBLE) AS "Total Revenue", count(*) AS "Orders",
  round(CAST(sum(rev) AS DOUBLE) / count(*), 6) AS "AOV (Mean)" FROM o GROUP BY ALL""")

_MEAS = """CAST(sum(rev) AS DOUBLE) AS "Total Revenue", CAST(sum(rev) FILTER (NOT cut) AS DOUBLE) AS "Revenue (Trend)",
  CAST(sum(frt) AS DOUBLE) AS "Total Freight", round(CAST(sum(frt) AS DOUBLE) / CAST(sum(rev) AS DOUBLE), 6) AS "Freight % of Revenue",
  count(*) AS "Orders", count(DISTINCT who) AS "Customers", round(CAST(sum(rev) AS DOUBLE) / count(*), 6) AS "AOV (Mean)",
  round(CAST(sum(rev) FILTER (kind = 'credit_card') AS DOUBLE) / nullif(count(*) FILTER (kind = 'credit_card'), 0), 6) AS "AOV (Credit Card)",
  round(count(*) FILTER (n_items > 1) / CAST(count(*) AS DOUBLE), 6) AS "Multi-Item Order %",
  round(count(*) FILTER (late) / CAST(count(*) AS DOUBLE), 6) AS "Late Rate %", round(avg(days), 6) AS "Avg Delivery Days",
  round(avg(score), 6) AS "Avg Review Score", round(count(*) FILTER (score = 1) / CAST(count(score) AS DOUBLE), 6) AS "One-Star Rate %" FROM o"""
S["measures_orders"] = q(BASE, "SELECT " + _MEAS)
S["measures_orders_by_month"] = q(BASE, "SELECT month AS order_month, " + _MEAS + " GROUP BY month")
S["measure_median_by_state"] = q(BASE, """SELECT state AS customer_state, round(median(CAST(rev AS DOUBLE)), 6) AS "AOV (Median)" FROM o GROUP BY state""")
S["measure_revenue_mom"] = q(BASE, """t AS (SELECT month, CAST(coalesce(sum(rev) FILTER (NOT cut), 0) AS DOUBLE) AS r, bool_or(cut) AS p FROM o GROUP BY month),
sp AS (SELECT strftime(unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 1 MONTH)), '%Y-%m') AS month),
u AS (SELECT month, r, p, lag(r) OVER (ORDER BY month) AS b FROM sp LEFT JOIN t USING (month))""", """
SELECT month AS order_month, r AS "Revenue (Trend)", CASE WHEN NOT p THEN round((r - b) / b, 6) END AS "Revenue MoM %" FROM u WHERE r IS NOT NULL""")
_RP = "rp AS (SELECT cohort_month, age, round(100.0 * customers / CAST(cohort_size AS DOUBLE), 4) AS p FROM cells JOIN size USING (co))"
S["measures_retention"] = q(COH, _RP, """
SELECT age AS months_since_first_purchase, round(avg(p) / 100, 12) AS "Avg Retention %",
  round(avg(p) FILTER (age > 0) / 100, 12) AS "Retention % After Month 0" FROM rp GROUP BY age""")
S["measures_cohort"] = q(COH, """
SELECT cohort_month, CASE WHEN 2001 * 12 + 7 - co >= 3 THEN round(round(100.0 * count(DISTINCT who) FILTER (age BETWEEN 1 AND 3)
  / CAST(count(DISTINCT who) AS DOUBLE), 4) / 100, 6) END AS "3-Month Repeat Rate %" FROM lab GROUP BY cohort_month, co""")
S["measures_items_by_category"] = q(F2, """
SELECT category, CAST(sum(rev) AS DOUBLE) AS "Item Revenue", count(*) AS "Items Sold", count(DISTINCT pid) AS "Products Sold",
  round(CAST(sum(rev) AS DOUBLE) / count(*), 6) AS "Avg Item Price" FROM f2 GROUP BY category""")
S["measures_category"] = q(F2, _CAT, _MOM, """
SELECT category, change AS "Category Momentum", units AS "Category Units", round(revenue / units, 2) AS "Category Avg Price"
FROM ct LEFT JOIN mo USING (category)""")
S["page_card_value_by_instalment"] = q(BASE, _FILTER, """
SELECT CAST(max_inst AS BIGINT) AS max_installments, round(CAST(sum(rev) FILTER (kind = 'credit_card') AS DOUBLE)
  / nullif(count(*) FILTER (kind = 'credit_card'), 0), 6) AS "AOV (Credit Card)" FROM o2 GROUP BY max_inst""")

# ---------------------------------------------------------------- tests
# Tail areas by Simpson's rule on 4,000 steps; the t quantile by its expansion in the normal one.
_NORMAL = "greatest(1 - 2 * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({z} * i / 4000, 2) / 2)) FROM range(4001) r(i)) * {z} / 12000 / sqrt(2 * pi()), 0)"
_TDENS = "(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - 0.5 * ln({v} * pi()))"
_TTAIL = ("greatest(1 - 2 * exp(" + _TDENS + ") * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
          " * pow(1 + pow(abs({t}) * i / 4000, 2) / {v}, -({v} + 1) / 2)) FROM range(4001) r(i)) * abs({t}) / 12000, 0)")
_Z = 1.959963984540054
_TQ = (f"({_Z} + {(_Z**3 + _Z) / 4!r} / {{v}} + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / pow({{v}}, 2)"
       f" + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / pow({{v}}, 3)"
       f" + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160!r} / pow({{v}}, 4))")


def welch(source: str, value: str, key: str | None, digits: int, log: bool = False) -> str:
    k, by = (f"{key} AS k", "GROUP BY 1") if key else ("0 AS k", "")
    n = digits
    head = "k AS customer_state, " if key else ""
    extra = f", CASE WHEN ok THEN round(exp(df), {n}) END AS geometric_mean_ratio" if log else ""
    return q(BASE, f"""w0 AS (SELECT {k}, count(*) FILTER (kind = 'credit_card') AS n1, count(*) FILTER (kind = 'boleto') AS n2,
  avg({value}) FILTER (kind = 'credit_card') AS m1, avg({value}) FILTER (kind = 'boleto') AS m2,
  var_samp({value}) FILTER (kind = 'credit_card') AS v1, var_samp({value}) FILTER (kind = 'boleto') AS v2
  FROM {source} AND kind IN ('credit_card', 'boleto') {by}),
w1 AS (SELECT *, least(n1, n2) >= 30 AS ok, m1 - m2 AS df, v1 / n1 AS e1, v2 / n2 AS e2,
  sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd FROM w0),
w2 AS (SELECT *, sqrt(e1 + e2) AS se, df / sqrt(e1 + e2) AS t,
  pow(e1 + e2, 2) / (pow(e1, 2) / (n1 - 1) + pow(e2, 2) / (n2 - 1)) AS v FROM w1),
w3 AS (SELECT *, {_TTAIL.format(t='t', v='v')} AS p, {_TQ.format(v='v')} * se AS reach FROM w2)""", f"""
SELECT {head}n1, n2, round(m1, {n}) AS mean1, round(m2, {n}) AS mean2, CASE WHEN ok THEN round(df, {n}) END AS difference,
  CASE WHEN ok THEN round(v, {n}) END AS dof, CASE WHEN ok THEN round(sd, {n}) END AS pooled_sd, CASE WHEN ok THEN round(t, {n}) END AS t,
  CASE WHEN ok THEN round(df / sd, {n}) END AS cohens_d, NOT ok AS insufficient_data, CASE WHEN ok THEN round(p, {n}) END AS p_value,
  CASE WHEN ok THEN round(df - reach, {n}) END AS ci_low, CASE WHEN ok THEN round(df + reach, {n}) END AS ci_high,
  CASE WHEN ok THEN CASE WHEN p < 0.05 THEN 'reject H0' ELSE 'fail to reject H0' END END AS decision{extra} FROM w3""")


S["test_welch_payment_value"] = welch("o WHERE true", "CAST(rev AS DOUBLE)", None, 4)
S["test_welch_by_state"] = welch("o WHERE true", "CAST(rev AS DOUBLE)", "state", 2)
S["test_welch_single_item"] = welch("o WHERE n_items = 1", "CAST(rev AS DOUBLE)", None, 4)
S["test_welch_log"] = welch("o WHERE rev > 0", "ln(CAST(rev AS DOUBLE))", None, 5, log=True)
S["test_detectable_effect"] = q(BASE, """w AS (SELECT count(*) FILTER (kind = 'credit_card') AS n1, count(*) FILTER (kind = 'boleto') AS n2,
  avg(CAST(rev AS DOUBLE)) FILTER (kind = 'credit_card') - avg(CAST(rev AS DOUBLE)) FILTER (kind = 'boleto') AS df,
  var_samp(CAST(rev AS DOUBLE)) FILTER (kind = 'credit_card') AS v1, var_samp(CAST(rev AS DOUBLE)) FILTER (kind = 'boleto') AS v2 FROM o),
x AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd, 2.8 * sqrt(1.0 / n1 + 1.0 / n2) AS d FROM w)""", """
SELECT n1, n2, round(d, 4) AS min_detectable_d, round(d * sd, 4) AS min_detectable_difference, round(df / sd, 4) AS observed_d,
  round(df, 4) AS observed_difference FROM x WHERE least(n1, n2) >= 30""")


def mann_whitney(key: str | None) -> str:
    part = f"PARTITION BY {key} " if key else ""
    k, head, by = (f"{key} AS k", "k AS customer_state, ", "GROUP BY 1") if key else ("0 AS k", "", "")
    return q(BASE, f"""r AS (SELECT {k}, kind, rank() OVER ({part}ORDER BY rev) + (count(*) OVER (PARTITION BY {key + ', ' if key else ''}rev) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY {key + ', ' if key else ''}rev) AS t FROM o WHERE kind IN ('credit_card', 'boleto')),
s AS (SELECT k, count(*) FILTER (kind = 'credit_card') AS n1, count(*) FILTER (kind = 'boleto') AS n2,
  CAST(sum(rk) FILTER (kind = 'credit_card') AS DOUBLE) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY k),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd FROM s),
z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sd AS z FROM u)""", f"""
SELECT {head}n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial,
  round(least({_NORMAL.format(z='abs(z)')}, 1), 6) AS p_value FROM z""")


S["test_mann_whitney"] = mann_whitney(None)
S["test_mann_whitney_by_state"] = mann_whitney("state")


def risk(key: str | None) -> str:
    k, head, by = (f"{key} AS k", "k AS customer_state, ", "GROUP BY 1") if key else ("0 AS k", "", "")
    return q(BASE, f"""c AS (SELECT {k}, CAST(count(*) FILTER (late) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT late) AS DOUBLE) AS n0,
  CAST(count(*) FILTER (late AND score = 1) AS DOUBLE) AS k1, CAST(count(*) FILTER (NOT late AND score = 1) AS DOUBLE) AS k0
  FROM o WHERE score IS NOT NULL {by}),
d AS (SELECT *, k1 / n1 AS p1, k0 / n0 AS p0, n1 + n0 AS n, least(k1, k0, n1 - k1, n0 - k0) = 0 AS hole,
  least(n1, n0) >= 30 AND least(k1, k0, n1 - k1, n0 - k0) > 0 AS ok, abs(k1 - n1 * (k1 + k0) / (n1 + n0)) AS g FROM c),
e AS (SELECT *, pow(g - least(g, 0.5), 2) * n * n * n / (n1 * n0 * (k1 + k0) * (n - k1 - k0)) AS x,
  sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) AS se FROM d),
f AS (SELECT *, {_NORMAL.format(z='sqrt(x)')} AS p FROM e)""", f"""
SELECT {head}CAST(n1 AS BIGINT) AS n_exposed, CAST(n0 AS BIGINT) AS n_other, round(p1, 6) AS rate_exposed, round(p0, 6) AS rate_other,
  CASE WHEN ok THEN round(x, 6) END AS chi2, CASE WHEN ok THEN round(p1 - p0, 6) END AS difference, CASE WHEN ok THEN round(p1 / p0, 6) END AS risk_ratio,
  NOT ok AS insufficient_data, CASE WHEN ok THEN round(sqrt(x / n), 6) END AS cramers_v, CASE WHEN ok THEN round(p1 - p0 - 1.96 * se, 6) END AS ci_low,
  CASE WHEN ok THEN round(p1 - p0 + 1.96 * se, 6) END AS ci_high, CASE WHEN ok THEN round(p, 6) END AS p_value,
  CASE WHEN ok THEN CASE WHEN p < 0.05 THEN 'reject H0' ELSE 'fail to reject H0' END END AS decision FROM f""")


S["test_late_vs_one_star"] = risk(None)
S["test_late_vs_one_star_by_state"] = risk("state")
S["test_late_first_vs_repeat"] = q(FIRST, f"""c AS (SELECT CAST(count(*) FILTER (late) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT late) AS DOUBLE) AS n0,
  CAST(count(*) FILTER (late AND back) AS DOUBLE) AS k1, CAST(count(*) FILTER (NOT late AND back) AS DOUBLE) AS k0 FROM fst),
d AS (SELECT *, k1 / n1 AS p1, k0 / n0 AS p0, (k1 + k0) / (n1 + n0) AS pp, least(n1, n0) >= 30 AND k1 + k0 > 0 AS ok FROM c),
e AS (SELECT *, (p1 - p0) / sqrt(pp * (1 - pp) * (1 / n1 + 1 / n0)) AS z, sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) AS se FROM d),
f AS (SELECT *, {_NORMAL.format(z='abs(z)')} AS p FROM e)""", """
SELECT CAST(n1 AS BIGINT) AS n_exposed, CAST(n0 AS BIGINT) AS n_other, round(p1, 6) AS rate_exposed, round(p0, 6) AS rate_other,
  CASE WHEN ok THEN round(p1 - p0, 6) END AS difference, CASE WHEN ok THEN round(z, 6) END AS z,
  CASE WHEN ok THEN round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p0)), 6) END AS cohens_h, NOT ok AS insufficient_data,
  CASE WHEN ok THEN round(p1 - p0 - 1.96 * se, 6) END AS ci_low, CASE WHEN ok THEN round(p1 - p0 + 1.96 * se, 6) END AS ci_high,
  CASE WHEN ok THEN round(p, 6) END AS p_value,
  CASE WHEN ok THEN CASE WHEN p < 0.05 THEN 'reject H0' ELSE 'fail to reject H0' END END AS decision FROM f""")
# Upper tail of chi-square with 4 degrees of freedom in closed form: exp(-x/2) (1 + x/2).
S["test_late_vs_score"] = q(BASE, """c AS (SELECT late, score, CAST(count(*) AS DOUBLE) AS n FROM o WHERE score IS NOT NULL GROUP BY ALL),
e AS (SELECT n, sum(n) OVER (PARTITION BY late) * sum(n) OVER (PARTITION BY score) / sum(n) OVER () AS e FROM c),
x AS (SELECT sum(pow(n - e, 2) / e) AS x, sum(n) AS n FROM e)""", """
SELECT CAST(n AS BIGINT) AS n, round(x, 6) AS chi2, CAST(4 AS BIGINT) AS dof, round(sqrt(x / n), 6) AS cramers_v,
  round(exp(-x / 2) * (1 + x / 2), 6) AS p_value FROM x""")

S["page_overview_cards"] = q(BASE, _FILTER, """SELECT CAST(sum(rev) AS DOUBLE) AS "Total Revenue", count(*) AS "Orders", count(DISTINCT who) AS "Customers",
  round(count(*) FILTER (late) / CAST(count(*) AS DOUBLE), 4) AS "Late Rate %", round(avg(score), 4) AS "Avg Review Score",
  round(CAST(sum(rev) AS DOUBLE) / count(*), 4) AS "AOV (Mean)", round(count(*) FILTER (score = 1) / CAST(count(score) AS DOUBLE), 4) AS "One-Star Rate %" FROM o2""")
S["page_overview_median"] = q(BASE, _FILTER, """SELECT round(median(CAST(rev AS DOUBLE)), 4) AS "AOV (Median)" FROM o2""")
S["page_overview_trend"] = q(BASE, _FILTER, """SELECT month AS order_month, CAST(sum(rev) FILTER (NOT cut) AS DOUBLE) AS "Revenue (Trend)" FROM o2 GROUP BY month""")
S["page_overview_states"] = q(BASE, """SELECT state AS customer_state, CAST(sum(rev) AS DOUBLE) AS "Total Revenue" FROM o GROUP BY state""")
S["page_customers_segments"] = q(DIM, """SELECT rfm_segment, CAST(sum(monetary_revenue) AS DOUBLE) AS "Segment Revenue" FROM dim GROUP BY 1""")
S["page_products_price_and_volume"] = q(F2, """SELECT category, count(*) AS "Category Units",
  round(round(CAST(sum(rev) AS DOUBLE) / count(*), 2), 4) AS "Category Avg Price", CAST(sum(rev) AS DOUBLE) AS "Item Revenue" FROM f2 GROUP BY category""")
S["page_products_best"] = q(f"x AS ({S['export_dim_product']})", """SELECT revenue_rank, category, units, avg_item_price, revenue, cumulative_pct_of_revenue
FROM x ORDER BY revenue_rank""")
S["page_marketing_payments"] = q(BASE, _FILTER, """SELECT kind AS payment_type, CAST(sum(rev) AS DOUBLE) AS "Total Revenue" FROM o2 GROUP BY kind""")


def _long(dataset: str, axis: str | None, source: str, **values: str) -> str:
    """Measures by axis as (dataset, axis_value, measure, value)."""
    by, group = (f"CAST({axis} AS VARCHAR)", f" GROUP BY {axis}") if axis else ("CAST(NULL AS VARCHAR)", "")
    return " UNION ALL ".join(f"SELECT '{dataset}' AS dataset, {by} AS axis_value, '{name}' AS measure, round(CAST({value} AS DOUBLE), 4) AS value FROM {source}{group}"
                              for name, value in values.items())


_LATE = "count(*) FILTER (late) / CAST(count(*) AS DOUBLE)"
_ORDER_CARDS = {"Total Revenue": "sum(rev)", "AOV (Mean)": "CAST(sum(rev) AS DOUBLE) / count(*)", "Late Rate %": _LATE, "Avg Review Score": "avg(score)"}
S["page_overview"] = q(BASE, _FILTER, "i2 AS (SELECT category, rev FROM f2 WHERE oid IN (SELECT oid FROM o2))", " UNION ALL ".join([
    _long("cards", None, "o2", **_ORDER_CARDS, **{"Orders": "count(*)", "Customers": "count(DISTINCT who)", "One-Star Rate %": "count(*) FILTER (score = 1) / CAST(count(score) AS DOUBLE)"}),
    _long("monthly_trend", "month", "o2", **{"Revenue (Trend)": "sum(rev) FILTER (NOT cut)"}),
    _long("revenue_by_state", "state", "o2", **{"Total Revenue": "sum(rev)"}),
    _long("revenue_by_category", "category", "i2", **{"Item Revenue": "sum(rev)"})]))
S["page_marketing"] = q(BASE, _FILTER, " UNION ALL ".join([
    _long("cards", None, "o2", **_ORDER_CARDS), _long("revenue_by_payment", "kind", "o2", **{"Total Revenue": "sum(rev)"}),
    _long("value_by_instalments", "CAST(max_inst AS BIGINT)", "o2", **{"AOV (Credit Card)": "CAST(sum(rev) FILTER (kind = 'credit_card') AS DOUBLE) / nullif(count(*) FILTER (kind = 'credit_card'), 0)"})]))
S["page_products"] = q(F2, f"x AS ({S['export_dim_category']})", " UNION ALL ".join([
    _long("cards", None, "f2", **{"Item Revenue": "sum(rev)", "Products Sold": "count(DISTINCT pid)", "Items Sold": "count(*)", "Avg Item Price": "CAST(sum(rev) AS DOUBLE) / count(*)"}),
    _long("momentum", "category", "x", **{"Category Momentum": "sum(momentum_change_brl)"}),
    _long("price_and_volume", "category", "x", **{"Category Units": "sum(units)", "Category Avg Price": "avg(avg_item_price)"}),
    _long("price_and_volume", "category", "f2", **{"Item Revenue": "sum(rev)"})]))
S["page_customers"] = q(f"c AS ({FACTS['export_dim_customers']}), r AS ({FACTS['retention_matrix']}), s AS ({FACTS['cohort_summary']})", " UNION ALL ".join([
    _long("cards", None, "c", **{"Segment Customers": "count(*)", "Repeat Rate %": "count(*) FILTER (is_repeat_customer) / CAST(count(*) AS DOUBLE)",
                                 "Repeat Customers": "count(*) FILTER (is_repeat_customer)", "Avg Customer Value": "CAST(sum(monetary_revenue) AS DOUBLE) / count(*)"}),
    _long("revenue_by_rfm", "rfm_segment", "c", **{"Segment Revenue": "sum(monetary_revenue)"}),
    _long("retention", "age", "r", **{"Retention % After Month 0": "avg(retention_pct) FILTER (age > 0) / 100"}),
    _long("fair_cohorts", "cohort_month", "s", **{"3-Month Repeat Rate %": "avg(repeat_rate_3mo_pct) / 100"})]))
S["page_marketing_states"] = q(BASE, _REGION, """SELECT customer_state, orders, round(aov, 4) AS aov, round(avg_delivery_days, 4) AS avg_delivery_days,
  round(late_rate_pct, 4) AS late_rate_pct, round(avg_review_score, 4) AS avg_review_score FROM reg""")
S["page_marketing_sellers"] = f"""SELECT seller_id, seller_state, orders_n, round(revenue, 4) AS revenue, round(late_rate_pct, 4) AS late_rate_pct,
  round(avg_review_score, 4) AS avg_review_score FROM ({S['export_dim_seller']})"""


# ---------------------------------------------------------------- measures in context
def by_axes(measures: dict[str, str], source: str, axes: tuple, digits: int = 6) -> str:
    """Measures by several axes as (axis, axis_value, measure, value); an axis is (name, expression) or None for all rows."""
    out = []
    for axis in axes:
        name, by, group = (axis[0], f"CAST({axis[1]} AS VARCHAR)", f" GROUP BY {axis[1]}") if axis else ("", "CAST(NULL AS VARCHAR)", "")
        out += [f"SELECT '{name}' AS axis, {by} AS axis_value, '{m}' AS measure, round(CAST({v} AS DOUBLE), {digits}) AS value FROM {source}{group}" for m, v in measures.items()]
    return " UNION ALL ".join(out)


_ORDER_VALUES = {
    "Total Revenue": "sum(rev)", "Revenue (Trend)": "sum(rev) FILTER (NOT cut)", "Total Freight": "sum(frt)", "Freight % of Revenue": "CAST(sum(frt) AS DOUBLE) / CAST(sum(rev) AS DOUBLE)",
    "Orders": "count(*)", "Customers": "count(DISTINCT who)", "AOV (Mean)": "CAST(sum(rev) AS DOUBLE) / count(*)",
    "AOV (Credit Card)": "CAST(sum(rev) FILTER (kind = 'credit_card') AS DOUBLE) / nullif(count(*) FILTER (kind = 'credit_card'), 0)",
    "Multi-Item Order %": "count(*) FILTER (n_items > 1) / CAST(count(*) AS DOUBLE)", "Late Rate %": _LATE, "Avg Delivery Days": "avg(days)", "Avg Review Score": "avg(score)",
    "One-Star Rate %": "count(*) FILTER (score = 1) / nullif(CAST(count(score) AS DOUBLE), 0)"}


def _mom(source: str, shown: str) -> str:
    """Month on month over `source`, for the months of `shown`."""
    return f"""SELECT 'order_month' AS axis, a.month AS axis_value, 'Revenue MoM %' AS measure,
  CASE WHEN a.partial = 0 THEN round((a.trend - b.trend) / nullif(b.trend, 0), 6) END AS value
FROM (SELECT month, CAST(sum(rev) FILTER (NOT cut) AS DOUBLE) AS trend, count(*) FILTER (cut) AS partial FROM {shown} GROUP BY month) a
LEFT JOIN (SELECT strftime(strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') AS month, CAST(sum(rev) FILTER (NOT cut) AS DOUBLE) AS trend
  FROM {source} GROUP BY month) b USING (month)"""


def _no_mom(name: str, by: str, source: str) -> str:
    values = f"SELECT DISTINCT {by} AS v FROM {source}" if by else "SELECT NULL AS v"
    return f"SELECT '{name}' AS axis, CAST(v AS VARCHAR) AS axis_value, 'Revenue MoM %' AS measure, CAST(NULL AS DOUBLE) AS value FROM ({values})"


S["context_orders"] = q(BASE, " UNION ALL ".join([
    by_axes(_ORDER_VALUES, "o", (("order_month", "month"), ("customer_state", "state"), ("payment_type", "kind"), None)), _mom("o", "o"),
    _no_mom("customer_state", "state", "o"), _no_mom("payment_type", "kind", "o"), _no_mom("", "", "o")]))
S["context_orders_sliced"] = q(BASE, "p AS (SELECT * FROM o WHERE kind IN ('credit_card', 'boleto'))", "s AS (SELECT * FROM p WHERE month BETWEEN '1997-03' AND '1998-10')", " UNION ALL ".join([
    by_axes(_ORDER_VALUES, "s", (("order_month", "month"), ("customer_state", "state"), None)), _mom("p", "s"), _no_mom("customer_state", "state", "s"), _no_mom("", "", "s")]))
S["context_order_medians"] = q(BASE, by_axes({"AOV (Median)": "median(CAST(rev AS DOUBLE))"}, "o", (("order_month", "month"), ("customer_state", "state"), ("payment_type", "kind"))))
S["context_items"] = q(F2, by_axes({"Item Revenue": "sum(rev)", "Items Sold": "count(*)", "Products Sold": "count(DISTINCT pid)", "Avg Item Price": "CAST(sum(rev) AS DOUBLE) / count(*)"},
                                    "f2", (("category", "category"), ("seller_state", "seller_state"), ("customer_state", "state"))))
_PEOPLE_VALUES = {
    "Segment Customers": "count(*)", "Segment Revenue": "sum(monetary_revenue)", "Repeat Customers": "count(*) FILTER (is_repeat_customer)",
    "Repeat Rate %": "count(*) FILTER (is_repeat_customer) / CAST(count(*) AS DOUBLE)", "Avg Customer Value": "CAST(sum(monetary_revenue) AS DOUBLE) / count(*)",
    "Segment Revenue %": "CAST(sum(monetary_revenue) AS DOUBLE) / (SELECT CAST(sum(monetary_revenue) AS DOUBLE) FROM c)"}
_PEOPLE_AXES = (("rfm_segment", "rfm_segment"), ("risk_tier", "risk_tier"))
S["context_customers"] = q(f"c AS ({FACTS['export_dim_customers']})", by_axes(
    _PEOPLE_VALUES, "c", (*_PEOPLE_AXES, ("customer_state", "customer_state"), ("rfm_segment | risk_tier", "concat_ws(' | ', rfm_segment, risk_tier)"))))
S["context_customers_sliced"] = q(f"c AS ({FACTS['export_dim_customers']})", "s AS (SELECT * FROM c WHERE risk_tier LIKE '3%')", by_axes(_PEOPLE_VALUES, "s", (*_PEOPLE_AXES, None)))
S["context_retention"] = q(f"r AS ({FACTS['retention_matrix']})", by_axes(
    {"Avg Retention %": "avg(retention_pct) / 100", "Retention % After Month 0": "avg(retention_pct) FILTER (age > 0) / 100"}, "r",
    (("months_since_first_purchase", "age"), ("cohort_month", "cohort_month"), None), 12))
S["context_cohorts"] = q(f"s AS ({FACTS['cohort_summary']})", by_axes({"3-Month Repeat Rate %": "avg(repeat_rate_3mo_pct) / 100"}, "s", (("cohort_month", "cohort_month"), None)))
S["context_categories"] = q(f"x AS ({S['export_dim_category']})", by_axes(
    {"Category Momentum": "sum(momentum_change_brl)", "Category Units": "sum(units)", "Category Avg Price": "avg(avg_item_price)"}, "x", (("category", "category"), None)))
