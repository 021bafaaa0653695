"""Raw records that do not fit: set aside with file and reason, none lost."""

import pytest

from martlet.sources import raw
from martlet.sources.raw import RAW_SCHEMAS
from pyspark.sql.types import StructType

ITEMS = ["o1,1,p1,s1,2018-01-01 00:00:00,10.50,1.00", "o2,1,p1,s1,2018-01-01 00:00:00,10.50", "o3,1,p1,s1,2018-01-01 00:00:00,10.50,1.00,extra",
         "o4,x,p1,s1,2018-01-01 00:00:00,ten,1.00", "o5,1,p1,s1,yesterday,1.00,1.00", "o6,1,p1,s1,,,", '"o7,1,p1,s1,2018-01-01 00:00:00,1.00,1.00',
         '"o,8",1,p1,s1,2018-01-01 00:00:00,1.00,1.00']
REVIEWS = ['r1,o1,5,title,"two\nlines, and ""quotes""",2018-01-01 00:00:00,2018-01-02 00:00:00', "r2,o2,five,,,2018-01-01 00:00:00,2018-01-02 00:00:00", "r3,o3,4"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("raw")
    for table, ddl in RAW_SCHEMAS.items():
        lines = {"order_items": ITEMS, "reviews": REVIEWS}.get(table, [])
        (where / f"{table}.csv").write_text("\n".join([",".join(StructType.fromDDL(ddl).names), *lines]) + "\n")
    return str(where)


def test_kept_and_rejected_are_all_records(spark, folder):
    read = raw.read_checked_csv(spark, folder)
    items = {r["order_id"]: r for r in read.tables["order_items"].collect()}
    assert set(items) == {"o1", "o4", "o5", "o6", "o,8"}
    assert items["o4"]["order_item_id"] is None and items["o4"]["price"] is None and items["o1"]["price"] is not None
    assert read.tables["order_items"].dtypes == spark.createDataFrame([], RAW_SCHEMAS["order_items"]).dtypes
    bad = {r["record"].lstrip('"')[:2]: r for r in read.issues.where("table = 'order_items'").collect()}
    assert {k for k, r in bad.items() if r["rejected"]} == {"o2", "o3", "o7"}
    assert len(items) + 3 == len(ITEMS)
    assert [(p["column"], p["found"]) for p in bad["o4"]["problems"]] == [("order_item_id", "x"), ("price", "ten")]
    assert [p["column"] for p in bad["o5"]["problems"]] == ["shipping_limit_date"] and not bad["o5"]["rejected"]
    assert bad["o2"]["problems"][0]["column"] is None and bad["o2"]["file"].endswith("order_items.csv")


def test_pruned_columns_change_nothing(spark, folder):
    items = raw.read_checked_csv(spark, folder).tables["order_items"]
    assert items.count() == 5 and items.select("seller_id").count() == 5 and items.select("price").where("price is not null").count() == 3


def test_multi_line_reviews_and_empty_tables(spark, folder):
    read = raw.read_checked_csv(spark, folder)
    reviews = {r["review_id"]: r for r in read.tables["reviews"].collect()}
    assert set(reviews) == {"r1", "r2"} and reviews["r1"]["review_comment_message"] == 'two\nlines, and "quotes"'
    assert reviews["r2"]["review_score"] is None
    assert read.tables["orders"].count() == 0


def test_untyped_records_can_be_rejected(spark, folder):
    read = raw.read_checked_csv(spark, folder, reject_untyped=True)
    assert {r["order_id"] for r in read.tables["order_items"].collect()} == {"o1", "o5", "o6", "o,8"}
    report = {(r["table"], r["column"]): r for r in raw.issue_report(read.issues).collect()}
    assert report["order_items", None]["records"] == report["order_items", None]["rejected"] == 3
    assert report["order_items", "price"]["rejected"] == 1 and report["order_items", "shipping_limit_date"]["rejected"] == 0
    assert report["reviews", "review_score"]["example"] == "five"
