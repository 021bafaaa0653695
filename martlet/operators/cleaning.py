"""Flag, do not delete: one cleaning job per raw table.

Rows are only removed where keeping them would multiply a join (repeated reviews, repeated
geolocation points, coordinates outside the bounding box).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions import calendar as cal
from martlet.functions.text import code, normalise
from martlet.operators.ordered import exact_quantiles

# Raw timestamp columns and the stage durations derived from them.
ORDER_TIMES = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"]
STAGE_DAYS = {
    "approval_days": ("order_approved_at", "order_purchase_timestamp"),
    "carrier_days": ("order_delivered_carrier_date", "order_approved_at"),
    "shipping_days": ("order_delivered_customer_date", "order_delivered_carrier_date"),
    "delivery_days": ("order_delivered_customer_date", "order_purchase_timestamp"),
}
SIZE_COLUMNS = ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]


def parse_times(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({
        c: cal.parse_ts(c, df.schema[c].dataType.simpleString()).cast("timestamp_ntz") for c in columns})


def clean_orders(raw: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    """Calendar columns, stage durations and quality flags; one row in, one row out.

    A negative duration sets ``timeline_valid`` to false and becomes NULL, the timestamps stay.
    An order with no delivery date is not late.
    """
    df = parse_times(raw, ORDER_TIMES)
    bought, arrived = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    delivered = F.col("order_status").isin(*defs.realised_statuses)
    spans = {name: cal.days_between(a, b) for name, (a, b) in STAGE_DAYS.items()}
    versus = cal.days_between(arrived, "order_estimated_delivery_date")
    negative = reduce(or_, [F.coalesce(d < 0, F.lit(False)) for d in spans.values()])
    return df.select(
        "*",
        delivered.alias("is_delivered"),
        F.coalesce(cal.in_dates(bought, defs.window_start, defs.window_end), F.lit(False)).alias("in_window"),
        F.to_date(bought).alias("order_date"), F.year(bought).alias("order_year"),
        cal.month_label(bought).alias("order_month"), cal.quarter_label(bought).alias("order_quarter"),
        cal.day_name(bought).alias("order_dow"), F.hour(bought).alias("order_hour"),
        *[F.when(d >= 0, d).alias(name) for name, d in spans.items()],
        cal.days_between("order_estimated_delivery_date", bought).alias("estimated_days"),
        versus.alias("delivery_vs_estimate_days"),
        F.coalesce(versus > 0, F.lit(False)).alias("is_late"),
        (~negative).alias("timeline_valid"),
        (delivered == arrived.isNull()).alias("status_date_conflict"))


def clean_items(raw: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    """Price outliers stay: they are a real product tier."""
    df = parse_times(raw, ["shipping_limit_date"])
    limit = F.col("shipping_limit_date")
    inside = limit.between(F.lit(defs.shipping_limit_from).cast("timestamp_ntz"),
                           F.lit(defs.shipping_limit_to).cast("timestamp_ntz"))
    return df.withColumns({
        "invalid_shipping_limit": ~F.coalesce(inside, F.lit(False)),
        "free_freight": F.col("freight_value") == 0,
        "item_total": (F.col("price") + F.col("freight_value")).cast("decimal(18,2)")})


def _clean_place(raw: DataFrame, role: str) -> DataFrame:
    city, state = f"{role}_city", f"{role}_state"
    return raw.withColumns({f"{city}_raw": F.col(city), city: normalise(city), state: code(state)})


def clean_customers(raw: DataFrame) -> DataFrame:
    return _clean_place(raw, "customer")


def clean_sellers(raw: DataFrame) -> DataFrame:
    return _clean_place(raw, "seller")


def translation_table(translation: DataFrame, manual: dict[str, str]) -> DataFrame:
    """Given translations plus manual rows; the given row wins where both name a category."""
    schema = "product_category_name string, product_category_name_english string"
    extra = translation.sparkSession.createDataFrame(list(manual.items()), schema)
    ranked = translation.select("*", F.lit(0).alias("rank")).unionByName(extra.select("*", F.lit(1).alias("rank")))
    return ranked.groupBy("product_category_name").agg(
        F.min_by("product_category_name_english", F.struct("rank", "product_category_name_english"))
        .alias("product_category_name_english"))


def clean_products(raw: DataFrame, translation: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    """English category by left join, explicit ``unknown`` bucket, impossible sizes to NULL."""
    df = raw.withColumnsRenamed({"product_name_lenght": "product_name_length",
                                 "product_description_lenght": "product_description_length"})
    names = translation_table(translation, defs.manual_translations)
    bad = reduce(or_, [F.coalesce(F.col(c) <= 0, F.lit(True)) for c in SIZE_COLUMNS])
    sizes = {c: F.when(F.col(c) > 0, F.col(c)) for c in SIZE_COLUMNS}
    flagged = df.withColumns({"category_missing": F.col("product_category_name").isNull(),
                              "invalid_dimensions": bad})
    volume = F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")
    return (flagged.withColumns(sizes)
            .join(names, "product_category_name", "left")
            .withColumn("product_volume_cm3", volume)
            .na.fill("unknown", ["product_category_name", "product_category_name_english"]))


def clean_payments(raw: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    """Zero, undefined and valueless payments are flagged; zero instalments become one."""
    totals = raw.groupBy("order_id").agg((F.sum("payment_value") == 0).alias("order_has_no_payment_value"))
    kind = F.trim("payment_type")
    zero, undefined = F.col("payment_value") == 0, kind == defs.undefined_payment
    none = F.col("payment_installments") == 0
    return raw.join(totals, "order_id", "left").select(
        "order_id", "payment_sequential", kind.alias("payment_type"),
        F.when(none, 1).otherwise(F.col("payment_installments")).alias("payment_installments"),
        "payment_value", zero.alias("zero_value"), "order_has_no_payment_value",
        undefined.alias("undefined_type"), none.alias("installments_imputed"),
        F.coalesce(~(zero | undefined), F.lit(False)).alias("is_valid_payment"))


def clean_reviews(raw: DataFrame) -> DataFrame:
    """The latest review per order, by answer then creation time; an open answer counts latest.

    A single aggregation with ``max_by``, so copies of one order combine before the shuffle; one for each column, all by the
    same order, so that columns nobody reads are not carried along.
    """
    df = parse_times(raw, ["review_creation_date", "review_answer_timestamp"])
    answered, created = F.col("review_answer_timestamp"), F.col("review_creation_date")
    recency = F.struct(answered.isNull(), answered, created.isNull(), created, F.col("review_id"))
    kept = [c for c in df.columns if c != "order_id"]
    latest = df.groupBy("order_id").agg(
        *[F.max_by(c, recency).alias(c) for c in kept], F.count(F.lit(1)).alias("n"))
    return latest.select("order_id", *kept, (F.col("n") > 1).alias("had_multiple_reviews")).withColumns({
        "has_comment": F.col("review_comment_message").isNotNull(),
        "response_days": cal.days_between(answered, created)})


def inside_box(defs: Definitions):
    return (F.col("geolocation_lat").between(*defs.latitude_box)
            & F.col("geolocation_lng").between(*defs.longitude_box))


def _most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-null value per key, the smallest on a tie, from a value histogram."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max("n").alias("n"))
    return counts.join(best, [key, "n"]).groupBy(key).agg(F.min(value).alias(value))


def clean_geolocation(raw: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    """One row per zip prefix: median point, most common city and state, number of points.

    Medians come from micro-degree histograms, so a prefix that holds a third of all points is
    spread over many tasks.
    """
    zip_code = "geolocation_zip_code_prefix"
    df = raw.where(inside_box(defs)).withColumn("geolocation_city", normalise("geolocation_city"))
    scale = 10 ** 8
    out = df.groupBy(zip_code).agg(F.count(F.lit(1)).alias("n_observations"))
    for c in ("geolocation_lat", "geolocation_lng"):
        middle = exact_quantiles(df.withColumn("_units", F.round(F.col(c) * scale).cast("bigint")),
                                 "_units", {c: 0.5}, groups=[zip_code], unit=scale)
        out = out.join(middle, zip_code, "left")
    for c in ("geolocation_city", "geolocation_state"):
        out = out.join(_most_common(df, zip_code, c), zip_code, "left")
    return out.select(zip_code, "geolocation_lat", "geolocation_lng", "geolocation_city",
                      "geolocation_state", "n_observations")
