"""Raw CSV tables with declared schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from martlet.sources.storage import exists

# The raw column layout. Timestamps are read as text and parsed while cleaning, so
# that a bad value becomes NULL there and stays countable here.
RAW_SCHEMAS: dict[str, str] = {
    "orders": "order_id string, customer_id string, order_status string, "
              "order_purchase_timestamp string, order_approved_at string, "
              "order_delivered_carrier_date string, order_delivered_customer_date string, "
              "order_estimated_delivery_date string",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
                   "shipping_limit_date string, price decimal(18,2), freight_value decimal(18,2)",
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
                 "customer_city string, customer_state string",
    "products": "product_id string, product_category_name string, product_name_lenght double, "
                "product_description_lenght double, product_photos_qty double, "
                "product_weight_g double, product_length_cm double, product_height_cm double, "
                "product_width_cm double",
    "payments": "order_id string, payment_sequential int, payment_type string, "
                "payment_installments int, payment_value decimal(18,2)",
    "reviews": "review_id string, order_id string, review_score int, review_comment_title string, "
               "review_comment_message string, review_creation_date string, "
               "review_answer_timestamp string",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, "
               "seller_state string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, "
                   "geolocation_lng double, geolocation_city string, geolocation_state string",
    "category_translation": "product_category_name string, product_category_name_english string",
}

# Declared key of each raw table (geolocation has none).
GRAIN: dict[str, list[str] | None] = {
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "customers": ["customer_id"],
    "products": ["product_id"],
    "payments": ["order_id", "payment_sequential"],
    "reviews": ["review_id"],
    "sellers": ["seller_id"],
    "geolocation": None,
    "category_translation": ["product_category_name"],
}


def read_raw_csv(spark: SparkSession, directory: str,
                 files: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """One lazy frame per raw table. ``files`` maps a table to its file or folder name."""
    if not exists(spark, directory):
        raise FileNotFoundError(f"raw data directory not found: {directory}")
    names = {table: f"{table}.csv" for table in RAW_SCHEMAS} | dict(files or {})
    return {
        table: (spark.read.schema(schema)
                .options(header=True, mode="PERMISSIVE", multiLine=table == "reviews",
                         quote='"', escape='"')
                .csv(f"{directory}/{names[table]}"))
        for table, schema in RAW_SCHEMAS.items()
    }


# Text columns that hold times.
RAW_TIMES: dict[str, list[str]] = {
    "orders": ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "order_items": ["shipping_limit_date"],
    "reviews": ["review_creation_date", "review_answer_timestamp"],
}

#: Column that holds the whole record where its fields do not fit the header.
MALFORMED = "_malformed_record"


@dataclass(frozen=True)
class CheckedTables:
    """Raw tables without the rejected records, and every record with a problem."""

    tables: dict[str, DataFrame]
    issues: DataFrame


def _checked(lines: DataFrame, table: str, reject_untyped: bool) -> tuple[DataFrame, DataFrame]:
    schema = StructType.fromDDL(RAW_SCHEMAS[table])
    times = RAW_TIMES.get(table, [])

    def unreadable(name: str, kind: str):
        bad = (F.trim(name) != "") & F.col(name).try_cast(kind).isNull()
        return F.when(bad, F.struct(F.lit(name).alias("column"), F.lit(kind).alias("expected"), F.col(name).alias("found")))
    typed = [unreadable(f.name, f.dataType.simpleString()) for f in schema if f.dataType != StringType()]
    whole = F.when(F.col(MALFORMED).isNotNull(), F.struct(
        F.lit(None).cast("string").alias("column"), F.lit(f"{len(schema)} fields").alias("expected"), F.col(MALFORMED).alias("found")))
    # The fields of a malformed record are shifted, so only the record itself is a problem.
    fields = F.array_compact(F.array(*typed, *[unreadable(c, "timestamp_ntz") for c in times]))
    judged = lines.withColumn("_problems", F.when(whole.isNotNull(), F.array(whole)).otherwise(fields))
    # Every column is named, so a query of few columns still has records judged by all their fields.
    refused = F.col(MALFORMED).isNotNull() & (F.concat_ws("", *schema.names) >= "")
    if reject_untyped and typed:
        refused = refused | F.coalesce(*typed).isNotNull()
    judged = judged.withColumn("_rejected", refused)
    kept = judged.where(~F.col("_rejected")).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
    record = F.coalesce(F.col(MALFORMED), F.to_csv(F.struct(*schema.names)))
    issues = judged.where(F.size("_problems") > 0).select(
        F.lit(table).alias("table"), "file", record.alias("record"), F.col("_problems").alias("problems"), F.col("_rejected").alias("rejected"))
    return kept, issues


def read_checked_csv(spark: SparkSession, directory: str, files: Mapping[str, str] | None = None,
                     reject_untyped: bool = False) -> CheckedTables:
    """Raw tables as ``read_raw_csv`` gives them, with the records that do not fit set aside.

    A record with more or fewer fields than the header, or with a quote left open, is rejected. A number or a time that cannot
    be read becomes NULL (times stay text and are parsed while cleaning) and the record is kept, or rejected for numbers if
    ``reject_untyped``; either way it is an issue. Empty fields are missing, not unreadable. Kept and rejected records together
    are the records of the file. ``issues``: table, file, record, problems (column, expected, found), rejected; a malformed
    record has one problem without a column.
    """
    if not exists(spark, directory):
        raise FileNotFoundError(f"raw data directory not found: {directory}")
    names = {table: f"{table}.csv" for table in RAW_SCHEMAS} | dict(files or {})
    tables, issues = {}, []
    for table, ddl in RAW_SCHEMAS.items():
        text = ", ".join(f"{c} string" for c in StructType.fromDDL(ddl).names)
        lines = (spark.read.schema(f"{text}, {MALFORMED} string")
                 .options(header=True, mode="PERMISSIVE", multiLine=table == "reviews", quote='"', escape='"',
                          columnNameOfCorruptRecord=MALFORMED, columnPruning=False)
                 .csv(f"{directory}/{names[table]}").withColumn("file", F.col("_metadata.file_path")))
        tables[table], found = _checked(lines, table, reject_untyped)
        issues.append(found)
    return CheckedTables(tables, reduce(DataFrame.unionByName, issues))


def issue_report(issues: DataFrame) -> DataFrame:
    """Records with a problem per table and column (NULL for malformed records), and how many of them were rejected."""
    each = issues.select("table", "rejected", F.explode("problems").alias("p"))
    return each.groupBy("table", F.col("p.column").alias("column"), F.col("p.expected").alias("expected")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("rejected").alias("rejected"), F.min("p.found").alias("example"))


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame],
                   columns: Mapping[str, Iterable[str]] | None = None) -> None:
    """Make tables reachable from SQL; ``columns`` limits a table to its declared columns."""
    for name, frame in tables.items():
        wanted = list((columns or {}).get(name, frame.columns))
        frame.select(*[c for c in wanted if c in frame.columns]).createOrReplaceTempView(name)
