"""Figures and keys of a frame from one scan, against counting by hand."""

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlet.operators import audits
from martlet.operators.quality import duplicates

ROWS = [(1, "a", 1.5), (1, "a", 1.5), (1, "b", None), (None, "b", 2.0), (None, "b", 2.0), (2, None, -1.0)] + [(7, "hot", 0.5)] * 200


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "k int, t string, v double").repartition(5)


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ")


def test_figures_and_two_keys(frame):
    audit = audits.Audit(frame, {"rows": audits.rows(), "sum": audits.amount("v"), "negative": audits.count_where(F.col("v") < 0),
                                 "low": audits.lowest("v"), "high": audits.highest("v")}, {"k": ["k"], "both": ["k", "t"], "whole": ["k", "t", "v"]})
    row = audit.row().first().asDict()
    assert row["rows"] == len(ROWS) and row["sum"] == sum(v or 0 for *_, v in ROWS) and row["negative"] == 1
    assert (row["low"], row["high"]) == (-1.0, 2.0)
    for name, width in (("k", 1), ("both", 2), ("whole", 3)):
        found = Counter(r[:width] for r in ROWS)
        assert row[f"{name}.surplus"] == sum(n - 1 for n in found.values())
        assert row[f"{name}.distinct"] == sum(None not in key for key in found)


def test_one_key_and_no_key_agree(frame):
    figures = {"rows": audits.rows(), "sum": audits.amount("v"), "low": audits.lowest("v")}
    with_key = audits.Audit(frame, figures, {"t": ["t"]}).row().select(*figures).first()
    assert with_key == audits.Audit(frame, figures).row().first()


def test_empty_frame(frame):
    none = frame.where("k > 100")
    for keys in ({}, {"k": ["k"]}, {"k": ["k"], "t": ["t"]}):
        row = audits.Audit(none, {"rows": audits.rows(), "sum": audits.amount("v"), "low": audits.lowest("v")}, keys).row().first().asDict()
        assert row["rows"] == 0 and row["sum"] == 0 and row["low"] is None
        assert all(v == 0 for n, v in row.items() if "." in n)


def test_compare_finds_what_fails(spark, frame):
    money = spark.createDataFrame([(Decimal("1.10"),), (Decimal("2.20"),)], "v decimal(18,2)")
    planned = {"f": audits.Audit(frame, {"rows": audits.rows(), "none": audits.lowest(F.lit(None).cast("int"))}, {"k": ["k"]}),
               "m": audits.Audit(money, {"sum": audits.amount("v")}), "m2": audits.Audit(money, {"sum": audits.amount(F.col("v").cast("double"))})}
    rows = {r["check"]: (r["result"], r["detail"]) for r in audits.compare(planned, [
        ("rows", ("f", "rows"), len(ROWS)), ("unique", ("f", "k.surplus"), 0), ("money", ("m", "sum"), ("m2", "sum")), ("missing", ("f", "none"), 0)]).collect()}
    assert rows["rows"] == ("PASS", f"{len(ROWS)} == {len(ROWS)}")
    assert rows["unique"][0] == "FAIL" and rows["unique"][1].endswith(" == 0")
    assert rows["money"][0] == "PASS" and rows["missing"] == ("FAIL", "NULL == 0")


def test_each_table_is_scanned_once(spark, tmp_path, frame):
    path = str(tmp_path / "t")
    frame.write.parquet(path)
    table = spark.read.parquet(path)
    assert _scans(duplicates({"t": table}, {"t": ["k"]})) == 1
    row = duplicates({"t": table}, {"t": ["k"]}).first()
    assert (row["rows"], row["exact_dup_rows"], row["dup_on_grain"]) == (len(ROWS), 201, 2 + 1 + 199)
