"""Shared building blocks: the sample tables in commerce terms."""

SHIP = """ship AS (
  SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
  FROM lineitem GROUP BY l_orderkey)"""

ORD = SHIP + """,
ord AS (
  SELECT o_orderkey AS oid, o_custkey AS cid, o_orderstatus AS status, o_orderdate AS bought,
    CASE WHEN o_orderkey % 211 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 72 AS INT)) END AS approved,
    first_ship AS picked, last_ship AS arrived, o_orderdate + INTERVAL 30 DAY AS promised,
    o_orderstatus = 'F' AS delivered,
    o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-08-01' AS in_window
  FROM orders LEFT JOIN ship ON l_orderkey = o_orderkey),
dur AS (
  SELECT *, (epoch_us(approved) - epoch_us(bought)) / 86400e6 AS a_days,
    (epoch_us(picked) - epoch_us(approved)) / 86400e6 AS c_days,
    (epoch_us(arrived) - epoch_us(picked)) / 86400e6 AS s_days,
    (epoch_us(arrived) - epoch_us(bought)) / 86400e6 AS d_days,
    (epoch_us(promised) - epoch_us(bought)) / 86400e6 AS e_days,
    (epoch_us(arrived) - epoch_us(promised)) / 86400e6 AS v_days
  FROM ord)"""

PERSON = """person AS (
  SELECT c_custkey AS cid, c_custkey AS who, upper(trim(n_name)) AS state
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""

F1 = ORD + ",\n" + PERSON + """,
f1 AS (
  SELECT oid, who, state, bought, CAST(bought AS DATE) AS day, strftime(bought, '%Y-%m') AS month,
    year(bought) || 'Q' || quarter(bought) AS quarter, year(bought) AS yr, dayname(bought) AS dow,
    CASE WHEN d_days >= 0 THEN d_days END AS dd, coalesce(v_days > 0, false) AS late, v_days
  FROM dur JOIN person USING (cid) WHERE delivered AND in_window)"""

LINE = """line AS (
  SELECT l_orderkey AS oid, l_linenumber AS ln, l_partkey AS pid, l_suppkey AS sid,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS rev,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS frt,
    CASE WHEN p_partkey % 53 <> 0 AND p_brand <> 'Brand#13' THEN lower(replace(p_brand, '#', '_'))
         ELSE 'unknown' END AS category, sn.n_name AS seller_state
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation sn ON sn.n_nationkey = s_nationkey)"""

F2 = F1 + ",\n" + LINE + """,
f2 AS (SELECT line.*, f1.* EXCLUDE (oid) FROM line JOIN f1 USING (oid)),
po AS (
  SELECT oid, any_value(who) AS who, any_value(state) AS state, any_value(day) AS day,
    any_value(month) AS month, any_value(quarter) AS quarter, any_value(yr) AS yr,
    any_value(bought) AS bought, any_value(dd) AS dd, any_value(late) AS late,
    sum(rev) AS rev, sum(frt) AS frt, count(*) AS units
  FROM f2 GROUP BY oid)"""

PAY = """pay AS (
  SELECT o_orderkey AS oid, 1 AS seq,
    trim(CASE WHEN o_orderkey % 500 = 3 THEN 'not_defined'
         WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'credit_card'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'boleto'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'debit_card' ELSE 'voucher' END) AS kind,
    CASE WHEN o_orderkey % 250 = 7 THEN 0 ELSE o_orderkey % 12 + 1 END AS inst0,
    CAST(CASE WHEN o_orderkey % 500 = 3 THEN 0 ELSE o_totalprice END AS DECIMAL(18,2)) AS val
  FROM orders
  UNION ALL
  SELECT o_orderkey, 2, 'voucher', 1,
    CAST(CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE o_orderkey % 1000 * 100 END AS DECIMAL(18,2))
  FROM orders WHERE o_orderkey % 4 = 0),
vpay AS (
  SELECT oid, seq, kind, greatest(inst0, 1) AS inst, val FROM pay WHERE val <> 0 AND kind <> 'not_defined'),
dom AS (
  SELECT oid, kind, inst FROM vpay QUALIFY row_number() OVER (PARTITION BY oid ORDER BY val DESC, seq) = 1),
paysum AS (SELECT oid, sum(val) AS paid, count(*) AS n_pay, max(inst) AS max_inst FROM vpay GROUP BY oid)"""

REV = """rawrev AS (
  SELECT o_orderkey AS rid, o_orderkey AS oid, (o_orderkey * 7 + o_custkey) % 5 + 1 AS score,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'order ' || o_orderkey END AS msg, o_orderdate + INTERVAL 10 DAY AS created,
    o_orderdate + INTERVAL 10 DAY + to_hours(CAST(o_orderkey % 48 + 24 AS INT)) AS answered
  FROM orders WHERE o_orderkey % 125 <> 0
  UNION ALL
  SELECT o_orderkey - o_orderkey % 3, o_orderkey,
    ((o_orderkey * 7 + o_custkey) % 5 + 1 + o_orderkey) % 5 + 1,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'order ' || o_orderkey END, o_orderdate + INTERVAL 10 DAY,
    CASE WHEN o_orderkey % 100 <> 1 THEN o_orderdate + INTERVAL 10 DAY + INTERVAL 96 HOUR END
  FROM orders WHERE o_orderkey % 50 = 1),
review AS (
  SELECT *, count(*) OVER (PARTITION BY oid) AS n_rev FROM rawrev
  QUALIFY row_number() OVER (PARTITION BY oid ORDER BY answered DESC NULLS FIRST, created DESC NULLS FIRST, rid DESC) = 1)"""


def even_share(amount: str, n: str) -> str:
    """``amount / n`` to two digits, half to even, in whole cents."""
    c = f"CAST({amount} * 100 AS BIGINT)"
    return (f"(({c} // {n}) + CAST(2 * ({c} % {n}) > {n} OR (2 * ({c} % {n}) = {n} AND ({c} // {n}) % 2 = 1) AS BIGINT))"
            " / CAST(100 AS DOUBLE)")


def q(*ctes_then_select: str) -> str:
    """``q(F2, "x AS (...)", "SELECT ...")`` as one statement."""
    *ctes, select = ctes_then_select
    return "WITH " + ",\n".join(ctes) + "\n" + select if ctes else select


# A full order fact for the base orders.
FACT = F2 + ",\n" + PAY + ",\n" + REV + """,
items AS (
  SELECT l_orderkey AS oid, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS rev,
    sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2))) AS frt,
    count(*) AS n_items, count(DISTINCT l_partkey) AS n_prod, count(DISTINCT l_suppkey) AS n_sell,
    max(CAST(l_extendedprice AS DECIMAL(18,2))) AS top
  FROM lineitem GROUP BY l_orderkey),
fo AS (
  SELECT f1.*, coalesce(items.rev, 0) AS rev, coalesce(items.frt, 0) AS frt, coalesce(n_items, 0) AS n_items,
    coalesce(n_prod, 0) AS n_prod, coalesce(n_sell, 0) AS n_sell, top, kind, max_inst, score
  FROM f1 LEFT JOIN items USING (oid) LEFT JOIN dom USING (oid) LEFT JOIN paysum USING (oid)
  LEFT JOIN (SELECT oid, score FROM review) r USING (oid))"""
