"""Cleaning rules on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from martlet.functions.text import normalise, normalise_any_script
from martlet.operators import cleaning, quality


def _orders(spark, rows):
    return spark.createDataFrame(rows, "order_id string, customer_id string, order_status string, order_purchase_timestamp string, "
                                       "order_approved_at string, order_delivered_carrier_date string, "
                                       "order_delivered_customer_date string, order_estimated_delivery_date string")


def test_orders_flags_and_durations(spark):
    raw = _orders(spark, [
        ("a", "1", "delivered", "2017-03-01 10:00:00", "2017-03-01 22:00:00", "2017-03-03 10:00:00", "2017-03-05 10:00:00", "2017-03-04 00:00:00"),
        ("b", "2", "delivered", "2017-03-01 10:00:00", None, None, None, "2017-03-20 00:00:00"),
        ("c", "3", "canceled", "2016-03-01 10:00:00", None, None, "2016-03-02 10:00:00", "2016-03-20 00:00:00"),
        ("d", "4", "delivered", "not a date", None, "2017-03-03 10:00:00", "2017-03-02 10:00:00", None),
        ("e", "5", "delivered", "2018-08-31 23:59:59", None, None, None, None)])
    got = {r.order_id: r for r in cleaning.clean_orders(raw).collect()}
    assert got["a"].delivery_days == 4.0 and got["a"].approval_days == 0.5 and got["a"].is_late and got["a"].timeline_valid
    assert got["a"].order_month == "2017-03" and got["a"].order_quarter == "2017Q1" and got["a"].order_dow == "Wednesday"
    assert got["b"].is_late is False and got["b"].status_date_conflict and got["b"].in_window
    assert got["c"].status_date_conflict and not got["c"].in_window and not got["c"].is_delivered
    assert got["d"].order_purchase_timestamp is None and not got["d"].in_window
    assert got["d"].shipping_days is None and not got["d"].timeline_valid
    assert got["e"].in_window


def test_time_rules_count_raw_violations(spark):
    raw = _orders(spark, [("d", "4", "delivered", "2017-03-05 00:00:00", None, "2017-03-03 10:00:00", "2017-03-02 10:00:00", None)])
    got = {r.rule: r.rows for r in quality.time_violations(cleaning.clean_orders(raw)).collect()}
    assert got == {"approved before purchase": 0, "carrier pickup before approval": 0, "delivered before carrier pickup": 1,
                   "delivered before purchase": 1}


def test_reviews_keep_the_latest_and_open_answers_win(spark):
    rows = [("r1", "o1", 5, None, "x", "2018-01-01 00:00:00", "2018-01-02 00:00:00"),
            ("r2", "o1", 1, None, None, "2018-01-01 00:00:00", "2018-01-03 00:00:00"),
            ("r3", "o2", 4, None, None, "2018-01-01 00:00:00", "2018-01-09 00:00:00"),
            ("r4", "o2", 2, None, "y", "2018-01-01 00:00:00", None),
            ("r5", "o3", 3, None, None, "2018-01-01 00:00:00", "2018-01-01 12:00:00")]
    raw = spark.createDataFrame(rows, "review_id string, order_id string, review_score int, review_comment_title string, "
                                      "review_comment_message string, review_creation_date string, review_answer_timestamp string")
    got = {r.order_id: r for r in cleaning.clean_reviews(raw).collect()}
    assert {k: v.review_id for k, v in got.items()} == {"o1": "r2", "o2": "r4", "o3": "r5"}
    assert got["o1"].had_multiple_reviews and not got["o3"].had_multiple_reviews
    assert got["o2"].has_comment and not got["o1"].has_comment and got["o3"].response_days == 0.5


def test_payments(spark):
    rows = [("o1", 1, " credit_card ", 0, 10.0), ("o1", 2, "voucher", 1, 0.0), ("o2", 1, "not_defined", 1, 0.0)]
    raw = spark.createDataFrame(rows, "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double")
    got = {(r.order_id, r.payment_sequential): r for r in cleaning.clean_payments(raw).collect()}
    first = got["o1", 1]
    assert first.payment_type == "credit_card" and first.payment_installments == 1 and first.installments_imputed and first.is_valid_payment
    assert got["o1", 2].zero_value and not got["o1", 2].is_valid_payment and not got["o1", 2].order_has_no_payment_value
    assert got["o2", 1].undefined_type and got["o2", 1].order_has_no_payment_value


def test_products_and_translation(spark):
    raw = spark.createDataFrame(
        [("p1", "moveis", 5.0, 9.0, 1.0, 100.0, 2.0, 3.0, 4.0), ("p2", None, 5.0, 9.0, 1.0, 0.0, 2.0, 3.0, 4.0),
         ("p3", "pc_gamer", 5.0, 9.0, 1.0, 100.0, 2.0, None, 4.0), ("p4", "novo", 5.0, 9.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
        "product_id string, product_category_name string, product_name_lenght double, product_description_lenght double, "
        "product_photos_qty double, product_weight_g double, product_length_cm double, product_height_cm double, product_width_cm double")
    names = spark.createDataFrame([("moveis", "furniture"), ("moveis", "furniture")], "product_category_name string, product_category_name_english string")
    got = {r.product_id: r for r in cleaning.clean_products(raw, names).collect()}
    assert len(got) == 4 and got["p1"].product_category_name_english == "furniture" and got["p1"].product_volume_cm3 == 24.0
    assert got["p2"].product_category_name == "unknown" and got["p2"].category_missing and got["p2"].product_weight_g is None and got["p2"].invalid_dimensions
    assert got["p3"].product_category_name_english == "pc_gamer" and got["p3"].invalid_dimensions
    assert got["p4"].product_category_name_english == "unknown" and not got["p4"].invalid_dimensions


def test_geolocation(spark):
    rows = [(1, -10.0, -50.0, "São Paulo", "SP"), (1, -12.0, -52.0, "sao-paulo", "SP"), (1, -12.0, -52.0, "campinas", "RJ"),
            (1, 60.0, -50.0, "far", "XX"), (2, -1.5, -40.0, "b", "B"), (2, -1.5, -40.0, "a", "A")]
    raw = spark.createDataFrame(rows, "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
                                      "geolocation_city string, geolocation_state string")
    got = {r.geolocation_zip_code_prefix: r for r in cleaning.clean_geolocation(raw).collect()}
    assert (got[1].geolocation_lat, got[1].geolocation_city, got[1].geolocation_state, got[1].n_observations) == (-12.0, "sao paulo", "SP", 3)
    assert (got[2].geolocation_city, got[2].geolocation_state) == ("a", "A")


@pytest.mark.parametrize("fn", [normalise, normalise_any_script])
def test_normalise(spark, fn):
    df = spark.createDataFrame([("  São  Paulo/SP ",), ("MOGI-GUAÇU",), ("são",), (None,)], "c string")
    assert [r.n for r in df.select(fn("c").alias("n")).collect()] == ["sao paulo sp", "mogi guacu", "sao", None]


def test_items_flags(spark):
    raw = spark.createDataFrame([("o", 1, "p", "s", "2020-01-01 00:00:00", 10.0, 0.0), ("o", 2, "p", "s", None, 5.0, 1.0)],
                                "order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_date string, price double, freight_value double")
    got = cleaning.clean_items(raw).orderBy("order_item_id").collect()
    assert [r.invalid_shipping_limit for r in got] == [True, True] and [r.free_freight for r in got] == [True, False]
    assert [float(r.item_total) for r in got] == [10.0, 6.0]
    assert got[0].shipping_limit_date == dt.datetime(2020, 1, 1)


def test_checks_raise(spark):
    bad = spark.createDataFrame([("x", "FAIL", "")], "check string, result string, detail string")
    with pytest.raises(AssertionError, match="x"):
        quality.require_passed(bad)
    quality.require_passed(bad.where(F.lit(False)))
