"""Data-quality audits over any set of tables. Each returns a small frame; none collects rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions import calendar as cal
from martlet.functions.numbers import big, cents, pct, scalar, total
from martlet.functions.windows import everything
from martlet.operators import audits
from martlet.operators.ordered import exact_quantiles


def _stack(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    return _stack(df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))
        for name, df in tables.items())


def column_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Type, non-null count and distinct count of every column: one scan a table, two shuffles for all columns together.

    Each row gives one (column, value) cell a column; cells are counted by value where they lie, so a value that many rows
    share costs one row a task, and then by column.
    """
    fields, cells = [], []
    for name, df in tables.items():
        first = len(fields)
        fields += [(first + i, name, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
        texts = [_as_text(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema.fields]
        cells.append(df.select(F.posexplode(F.array(*texts)).alias("at", "value")).where(F.col("value").isNotNull()).select((F.col("at") + first).alias("at"), "value"))
    values = _stack(cells).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = values.groupBy("at").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("n_unique"))
    named = counts.sparkSession.createDataFrame(fields, "at int, table string, column string, dtype string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return named.join(counts, "at", "left").select("table", "column", "dtype", zero("non_null"), zero("n_unique"))


def _as_text(c: Column, kind: str) -> Column:
    """Text that is equal for equal values only; numbers lose a negative zero, nested values become JSON."""
    if kind in ("double", "float"):
        return (c + F.lit(0.0)).cast("string")
    if kind.startswith(("array", "map", "struct")):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return F.base64(c) if kind == "binary" else c.cast("string")


def missing_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns with missing values: one aggregation per table, then one row per column."""
    frames = []
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        frames.append(row.unpivot(["rows"], df.columns, "column", "missing").select(
            F.lit(name).alias("table"), "column", "missing", F.round(pct("missing", "rows"), 2).alias("missing_pct"), "rows"))
    return _stack(frames).where(F.col("missing") > 0)


def duplicates(tables: Mapping[str, DataFrame], grain: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Surplus rows that repeat a whole row, and that repeat the declared key: one scan a table for both.

    Groups are combined map-side, so repeated rows cost one row per task.
    """
    frames = []
    for name, df in tables.items():
        key = grain.get(name)
        found = audits.Audit(df, {"rows": audits.rows()}, {"whole": df.columns} | ({"grain": key} if key else {})).row()
        exact = F.col("`whole.surplus`")
        frames.append(found.select(
            F.lit(name).alias("table"), big("rows").alias("rows"), exact.cast("bigint").alias("exact_dup_rows"),
            F.round(pct(exact, "rows"), 2).alias("exact_dup_pct"), F.lit(", ".join(key) if key else "(none)").alias("declared_grain"),
            (F.col("`grain.surplus`") if key else F.lit(None)).cast("bigint").alias("dup_on_grain")))
    return _stack(frames)


def key_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """How often a key repeats, and how often its rows disagree on a value."""
    cells = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    keys = cells.groupBy(key).agg(F.sum("n").alias("n"), F.count(value).alias("kinds"),
                                  F.max(value).alias("high"), F.min(value).alias("low"))
    several, disagree = F.col("n") > 1, (F.col("n") > 1) & (F.col("kinds") > 1)
    return keys.agg(
        big(F.sum("n")).alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(several).alias("repeated_keys"),
        big(F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0))).alias("rows_involved"),
        F.count_if(disagree).alias("conflicting_keys"),
        F.round(F.avg(F.when(disagree, (F.col("high") - F.col("low")).cast("double"))), 4).alias("mean_spread"))


def date_coverage(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Range, missing and unreadable values of date columns: one aggregation per table."""
    frames = []
    for name, names in columns.items():
        df, figures, cells = tables[name], [], []
        for i, c in enumerate(names):
            parsed = cal.parse_ts(c, df.schema[c].dataType.simpleString()).cast("timestamp_ntz")
            taken = {"min": F.min(parsed), "max": F.max(parsed), "missing": F.count_if(F.col(c).isNull()),
                     "unparseable": F.count_if(F.col(c).isNotNull() & parsed.isNull())}
            figures += [f.alias(f"{n}_{i}") for n, f in taken.items()]
            cells.append(F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), *[F.col(f"{n}_{i}").alias(n) for n in taken]))
        frames.append(df.agg(*figures).select(F.inline(F.array(*cells))))
    return _stack(frames)


def orphans(checks: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Child rows whose parent is missing, per foreign key.

    Keys are counted before the anti join, so a key with very many rows is one row in it.
    """
    frames = []
    for label, (child, child_key, parent, parent_key) in checks.items():
        keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        known = parent.select(F.col(parent_key).alias("k"), F.lit(True).alias("found")).distinct()
        lost = F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0))
        frames.append(keys.join(known, "k", "left").agg(
            big(lost).alias("orphans"), big(F.coalesce(F.sum("n"), F.lit(0))).alias("rows_checked")).select(
            F.lit(label).alias("foreign_key"), "orphans", "rows_checked",
            F.round(pct("orphans", "rows_checked"), 3).alias("orphan_pct")))
    return _stack(frames)


def childless_parents(parent: DataFrame, key: str, status: str, children: Mapping[str, DataFrame]) -> DataFrame:
    """Parents without a child row, by status, per child table."""
    return _stack(
        parent.join(child.select(key), key, "left_anti").groupBy(status).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("missing_child"), F.col(status).alias("status"), "n")
        for name, child in children.items())


def value_sanity(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that hit each rule."""
    row = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return row.unpivot([], list(rules), "rule", "rows")


# Temporal rules of an order, (earlier stage, later stage).
TIME_RULES = {
    "approved before purchase": ("order_purchase_timestamp", "order_approved_at"),
    "carrier pickup before approval": ("order_approved_at", "order_delivered_carrier_date"),
    "delivered before carrier pickup": ("order_delivered_carrier_date", "order_delivered_customer_date"),
    "delivered before purchase": ("order_purchase_timestamp", "order_delivered_customer_date"),
}


def time_violations(orders: DataFrame) -> DataFrame:
    return value_sanity(orders, {name: F.col(later) < F.col(earlier) for name, (earlier, later) in TIME_RULES.items()})


def status_consistency(orders: DataFrame) -> DataFrame:
    """Status against timestamps, on cleaned orders."""
    arrived = F.col("order_delivered_customer_date")
    return value_sanity(orders, {
        "delivered without delivery date": F.col("is_delivered") & arrived.isNull(),
        "delivered without approval": F.col("is_delivered") & F.col("order_approved_at").isNull(),
        "not delivered but has delivery date": ~F.col("is_delivered") & arrived.isNotNull()})


def reconciliation(items: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments against item totals per order, within tolerances."""
    due = items.groupBy("order_id").agg(F.sum(F.col("price") + F.col("freight_value")).alias("due"))
    paid = payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    gap = F.abs(F.col("paid") - F.col("due"))
    return due.join(paid, "order_id").agg(
        F.count(F.lit(1)).alias("orders_reconciled"), F.count_if(gap < 0.01).alias("exact_match"),
        F.count_if(gap > 1).alias("off_by_more_than_1"), F.count_if(gap > 10).alias("off_by_more_than_10"),
        F.round(F.sum(F.col("paid") - F.col("due")).cast("double"), 2).alias("net_difference"))


def translation_coverage(products: DataFrame, translation: DataFrame, items: DataFrame) -> DataFrame:
    """Categories without a translation, and the products, lines and revenue they carry."""
    name = "product_category_name"
    lacking = products.join(translation.select(name), name, "left_anti").select(
        "product_id", F.coalesce(name, F.lit("(no category)")).alias("category"))
    sold = items.groupBy("product_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("price").alias("revenue"))
    return lacking.join(sold, "product_id", "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("products"), big(F.coalesce(F.sum("lines"), F.lit(0))).alias("item_lines"),
        F.coalesce(total("revenue"), F.lit(0.0)).alias("gross_revenue"))


def unused_translations(products: DataFrame, translation: DataFrame) -> DataFrame:
    name = "product_category_name"
    return translation.select(name).distinct().join(products.select(name), name, "left_anti")


def zip_coverage(people: DataFrame, zip_column: str, points: DataFrame) -> DataFrame:
    """Rows whose zip prefix has no point."""
    return orphans({f"{zip_column} -> geolocation": (people, zip_column, points, "geolocation_zip_code_prefix")})


def coordinates(points: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    lat, lng = F.col("geolocation_lat"), F.col("geolocation_lng")
    outside = ~(lat.between(*defs.latitude_box) & lng.between(*defs.longitude_box))
    return points.agg(F.count(F.lit(1)).alias("rows"), F.count_if(outside).alias("outside_box"), F.min(lat).alias("lat_min"),
                      F.max(lat).alias("lat_max"), F.min(lng).alias("lng_min"), F.max(lng).alias("lng_max"))


def iqr_outliers(items: DataFrame) -> DataFrame:
    """What the quartile rule would throw away: rows, revenue share, products, recurrence."""
    edges = scalar(exact_quantiles(items.select(cents("price").alias("c")), "c", {"q1": 0.25, "q3": 0.75}, unit=100), "q1", "q3")
    fence = edges["q3"] + 1.5 * (edges["q3"] - edges["q1"])
    per_product = items.select("product_id", "price", (F.col("price").cast("double") > fence).alias("above")).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("price").alias("revenue"), F.count_if("above").alias("above"),
        F.sum(F.when(F.col("above"), F.col("price"))).alias("above_revenue"))
    row = per_product.agg(
        big(F.sum("rows")).alias("rows"), big(F.sum("above")).alias("flagged"), total("revenue").alias("revenue"),
        F.coalesce(total("above_revenue"), F.lit(0.0)).alias("flagged_revenue"), F.count_if(F.col("above") > 0).alias("products"),
        F.max("above").alias("most_recurring"), F.count_if(F.col("above") > 10).alias("products_over_10"))
    return row.select(
        F.round(edges["q1"], 4).alias("q1"), F.round(edges["q3"], 4).alias("q3"), F.round(fence, 4).alias("upper_fence"),
        "flagged", F.round(pct("flagged", "rows"), 4).alias("flagged_pct"), "flagged_revenue",
        F.round(pct("flagged_revenue", "revenue"), 4).alias("flagged_revenue_pct"), "products", "most_recurring", "products_over_10")


def distribution_shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Share of each value before and after a step, in percentage points."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return counts.select(column, F.round(F.try_divide(
            100.0 * F.col("n").cast("double"), F.sum("n").over(everything()).cast("double")), 2).alias(name))

    both = shares(before, "before_pct").join(shares(after, "after_pct"), column, "full")
    return both.withColumn("shift_pp", F.round(F.col("after_pct") - F.col("before_pct"), 3))


def delivery_clusters(orders: DataFrame, times: float = 1.5) -> DataFrame:
    """Days with far more deliveries than the median day of their month."""
    from pyspark.sql import Window

    days = orders.where(F.col("order_delivered_customer_date").isNotNull()).groupBy(
        F.to_date("order_delivered_customer_date").alias("delivery_date")).agg(
        F.count(F.lit(1)).alias("deliveries"), F.min("order_date").alias("first_purchase"), F.max("order_date").alias("last_purchase"))
    month = Window.partitionBy(F.date_format("delivery_date", "yyyy-MM"))
    return days.withColumn("typical", F.median("deliveries").over(month)).where(
        F.col("deliveries") >= times * F.col("typical")).select(
        "delivery_date", "deliveries", F.round("typical", 4).alias("typical_per_day"),
        F.round(F.col("deliveries") / F.col("typical"), 4).alias("times_typical"), "first_purchase", "last_purchase")


def validation_checks(raw: Mapping[str, DataFrame], orders: DataFrame, items: DataFrame, customers: DataFrame,
                      reviews: DataFrame, item_fact: DataFrame, order_fact: DataFrame,
                      points: DataFrame) -> DataFrame:
    """Twelve checks after cleaning: one row each with PASS or FAIL and the figures compared.

    Each table is read once for all its figures, those of its key included.
    """
    stages = ["approval_days", "carrier_days", "shipping_days", "delivery_days"]
    negative = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in stages])
    person, rows, count_where, amount = {"person": ["customer_unique_id"]}, audits.rows, audits.count_where, audits.amount
    planned = {
        "raw lines": audits.Audit(raw["order_items"], {"rows": rows(), "price": amount("price")}),
        "raw orders": audits.Audit(raw["orders"], {"rows": rows()}),
        "raw customers": audits.Audit(raw["customers"], keys=person),
        "lines": audits.Audit(item_fact, {"rows": rows(), "revenue": amount("revenue"),
                                          "unnamed": count_where(F.col("product_category_name_english").isNull())}),
        "fact": audits.Audit(order_fact, {"rows": rows(), "revenue": amount("order_revenue"),
                                          "unknown": count_where(F.col("customer_unique_id").isNull())}, {"order": ["order_id"]}),
        "orders": audits.Audit(orders, {"negative": count_where(negative)}),
        "items": audits.Audit(items, {"free": count_where(F.col("price") <= 0)}),
        "customers": audits.Audit(customers, keys=person),
        "reviews": audits.Audit(reviews, keys={"order": ["order_id"]}),
        "points": audits.Audit(points, keys={"zip": ["geolocation_zip_code_prefix"]}),
    }
    # The check list.
    return audits.compare(planned, [
        ("No row inflation in item fact table", ("lines", "rows"), ("raw lines", "rows")),
        ("No row inflation in order fact table", ("fact", "rows"), ("raw orders", "rows")),
        ("order_id is unique in fct_orders", ("fact", "order.surplus"), 0),
        ("Revenue preserved exactly (item grain)", ("lines", "revenue"), ("raw lines", "price")),
        ("Revenue preserved exactly (order grain)", ("fact", "revenue"), ("raw lines", "price")),
        ("Every order has a customer_unique_id", ("fact", "unknown"), 0),
        ("Every item line has an English category", ("lines", "unnamed"), 0),
        ("One review per order", ("reviews", "order.surplus"), 0),
        ("One geolocation row per zip prefix", ("points", "zip.surplus"), 0),
        ("No negative stage durations remain", ("orders", "negative"), 0),
        ("No negative or zero prices", ("items", "free"), 0),
        ("Customer count unchanged", ("customers", "person.distinct"), ("raw customers", "person.distinct")),
    ])


def require_passed(checks: DataFrame) -> None:
    """Raise when a check failed, naming the failures."""
    failed = [r["check"] for r in checks.where(F.col("result") != "PASS").collect()]
    if failed:
        raise AssertionError(f"{len(failed)} validation checks failed: {'; '.join(failed)}")
