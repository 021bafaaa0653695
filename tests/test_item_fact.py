"""The item fact keeps every line, and deals lines before the columns of their orders join them."""

import re
from datetime import datetime

import pytest

from martlet.config import Definitions
from martlet.operators import facts
from martlet.sources.market import Market

DAY = datetime(1998, 5, 4)


@pytest.fixture(scope="module")
def market(spark):
    """Lines without keys, with unknown keys and twice; an order, a customer, a product and a seller that are there twice."""
    orders = [(k, c, "F", True, True, DAY, DAY.date(), 1998, "1998-05", "1998Q2", "Monday", 3.0, False)
              for k, c in [*((k, k % 7) for k in range(40)), (5, 2), (6, None), (7, 99), (None, 1)]]
    customers = [(c, u, f"city {u}", f"S{u % 3}", u % 5) for c, u in [*((c, c) for c in range(7)), (3, 33), (None, 44)]]
    products = [(p, f"c{n % 4}", f"e{n % 4}", 1.0 * n, 2.0 * n, 3.0) for p, n in [*((p, p) for p in range(9)), (4, 44), (None, 55)]]
    sellers = [(s, f"city {n}", f"S{n % 3}") for s, n in [*((s, s) for s in range(5)), (2, 22), (None, 66)]]
    items = [(k, n, p, s, 10 * n + 1, n) for n, (k, p, s) in enumerate(
        [*((k % 45, k % 11, k % 6) for k in range(150)), (None, 1, 1), (1, None, 1), (1, 1, None), (None, None, None)])]
    items += items[:4]
    frames = {
        "orders": (orders, "order_id long, customer_id long, order_status string, is_delivered boolean, in_window boolean, "
                           "order_purchase_timestamp timestamp_ntz, order_date date, order_year int, order_month string, "
                           "order_quarter string, order_dow string, delivery_days double, is_late boolean"),
        "customers": (customers, "customer_id long, customer_unique_id long, customer_city string, customer_state string, "
                                 "customer_zip_code_prefix long"),
        "products": (products, "product_id long, product_category_name string, product_category_name_english string, "
                               "product_weight_g double, product_volume_cm3 double, product_photos_qty double"),
        "sellers": (sellers, "seller_id long, seller_city string, seller_state string"),
        "items": (items, "order_id long, order_item_id long, product_id long, seller_id long, price long, freight_value long")}
    return Market({name: spark.createDataFrame(*frame) for name, frame in frames.items()}), frames


def by_key(rows, at=0):
    found = {}
    for row in rows:
        if row[at] is not None:
            found.setdefault(row[at], []).append(row)
    return lambda key: found.get(key, [(None,) * len(rows[0])])


def expected(frames, sellers):
    """The joins by hand: (keys, line, product, seller, order, customer, same_state)."""
    order, customer, product, seller = (by_key(frames[n][0]) for n in ("orders", "customers", "products", "sellers"))
    for k, n, p, s, price, freight in frames["items"][0]:
        for o in order(k):
            for c in customer(o[1]):
                for x in product(p):
                    for y in seller(s) if sellers else [()]:
                        yield (o[1], k, s, p, n, price, freight, *x[1:], *y[1:], *o[2:], *c[1:], *([c[3] == y[2]] if sellers else []))


@pytest.fixture
def nothing_small(spark):
    """As if no table were small enough for Spark to broadcast it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize(("most", "sellers", "dealt"), [(500_000, True, 2), (7, True, 2), (6, True, 3), (500_000, False, 2)])
def test_lines_are_dealt_while_narrow(market, nothing_small, monkeypatch, capsys, most, sellers, dealt):
    m, frames = market
    monkeypatch.setattr(facts, "FEW_SELLERS", most, raising=False)
    found = facts.order_items_fact(m, sellers)
    found.explain("formatted")
    inputs = re.findall(r"\) Exchange\nInput +\[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
    lines = [x for x in inputs if re.search(r"\bprice#", x)]
    assert len(lines) == dealt and not any("order_month#" in x or "customer_city#" in x for x in lines)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected(frames, sellers)))


@pytest.mark.parametrize("sellers", [True, False])
def test_base_lines_are_those_of_the_base_orders(market, nothing_small, sellers):
    m, frames = market
    inside = Market({n: getattr(m, n) for n in frames}, Definitions(window_start=DAY.date(), window_end=DAY.date()))
    got = facts.base_items(inside, sellers).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(x) for x in expected(frames, sellers) if DAY in x)
