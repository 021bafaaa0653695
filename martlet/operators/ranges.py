"""Row numbers and running sums over a whole table by ranges of the order: two passes, no global sort in one task.

A sample of the rows gives bounds that cut the order (value, key) into ranges of about ROWS_PER_RANGE rows. A row's range is
a function of the row and the bounds alone, so it is the same wherever and however often the row is computed, also after an
executor is lost. Rows are numbered inside their range; a table with one row a range holds the counts and sums of the ranges
before it. Bounds are cut from value and key together: neither one value that all rows share, nor ids with a common prefix,
nor sparse numbers can put more rows into a range. The sample only places the cuts; results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from martlet.functions.windows import everything

#: Rows of a range, sampled rows for each of them, and the most ranges (the table of ranges is numbered in one task; with
#: more than ROWS_PER_RANGE x MOST_RANGES rows the ranges grow).
ROWS_PER_RANGE, SAMPLES, MOST_RANGES = 1 << 18, 32, 4096


def order_columns(value: str, key: str, descending: bool = False) -> dict[str, Column]:
    """Three columns whose ascending order is that of value, then key. NULL is the smallest value and the smallest key."""
    v = F.col(value)
    return {"_null": v.isNull() if descending else v.isNotNull(), "_value": -1 - v if descending else v, "_key": F.col(key)}


def cut_points(ordered: DataFrame, rows: int) -> list[Row]:
    """Sorted bounds (_null, _value, _key) of the ranges but the first; about SAMPLES rows a range come to the driver."""
    ranges = min(MOST_RANGES, math.ceil(rows / ROWS_PER_RANGE))
    if ranges < 2:
        return []
    every = max(1, rows // (SAMPLES * ranges))
    sample = ordered.where(F.pmod(F.xxhash64("_value", "_key"), F.lit(every)) == 0).select("_null", "_value", "_key").collect()
    sample.sort(key=lambda r: (r["_null"], r["_value"], r["_key"] is not None, r["_key"]))
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    return [b for i, b in enumerate(bounds) if i == 0 or b != bounds[i - 1]]


def range_of(ordered: DataFrame, bounds: Sequence[Row]) -> Column:
    """How many bounds a row has reached, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    kinds = {c: ordered.schema[c].dataType for c in ("_null", "_value", "_key")}

    def literal(bound: Row) -> Column:
        return F.struct(*[F.lit(bound[c]).cast(t).alias(c) for c, t in kinds.items()])

    row = F.struct("_null", "_value", "_key")
    reached = lambda b: row >= b
    wide = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i:i + wide] for i in range(0, len(bounds), wide)]
    group = F.size(F.filter(F.array(*[literal(g[0]) for g in groups]), reached))
    inside = F.size(F.filter(F.element_at(F.array(*[F.array(*[literal(b) for b in g]) for g in groups]), group), reached))
    return F.when(group == 0, 0).otherwise((group - 1) * wide + inside)


def positions(df: DataFrame, value: str, key: str, out: str, descending: bool = False, sums: Mapping[str, Column] | None = None,
              rows: int | None = None) -> DataFrame:
    """Number the rows from 1 by ``value`` (BIGINT), then ``key``; equal pairs in any order.

    Adds ``out``, ``<out>_before`` (rows with an earlier value), ``<out>_total``, and for each of ``sums`` (whole numbers)
    the running sum up to the row and ``<name>_total``. ``rows`` is the number of rows where it is known; else they are counted.
    """
    sums = dict(sums or {})
    ordered = df.withColumns({**order_columns(value, key, descending), **{f"_add_{s}": c for s, c in sums.items()}})
    total = df.count() if rows is None else rows
    bounds = cut_points(ordered, total)
    by_range = Window.partitionBy("_range")
    by_row = by_range.orderBy("_null", "_value", "_key")
    numbered = ordered.withColumn("_range", range_of(ordered, bounds)).withColumns({
        "_row": F.row_number().over(by_row), "_rank": F.rank().over(by_range.orderBy("_null", "_value")),
        **{f"_run_{s}": F.sum(f"_add_{s}").over(by_row.rowsBetween(Window.unboundedPreceding, 0)) for s in sums}})
    ends = numbered.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_rank").alias("_last_rank"), F.min(F.struct("_null", "_value")).alias("_first"),
        F.max(F.struct("_null", "_value")).alias("_last"), *[F.sum(f"_add_{s}").alias(f"_sum_{s}") for s in sums])
    before = everything().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    prefix = ends.select(
        "_range", "_first", "_last", "_last_rank", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_skip_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(everything()).alias(f"{s}_total") for s in sums])
    # A value that goes on from an earlier range began where the first range that ends with it says.
    began = prefix.groupBy(F.col("_last").alias("_of")).agg(F.min(F.col("_skip") + F.col("_last_rank") - 1).alias("_began"))
    same = (F.col("_first._null") == F.col("_of._null")) & F.col("_first._value").eqNullSafe(F.col("_of._value"))
    prefix = prefix.join(began, same, "left").withColumn("_began", F.least(F.coalesce("_began", "_skip"), "_skip")).drop("_of", "_last", "_last_rank")
    at_first = (F.col("_null") == F.col("_first._null")) & F.col("_value").eqNullSafe(F.col("_first._value"))
    return numbered.join(prefix, "_range").select(
        *df.columns, (F.col("_skip") + F.col("_row")).cast("bigint").alias(out),
        F.when(at_first, F.col("_began")).otherwise(F.col("_skip") + F.col("_rank") - 1).cast("bigint").alias(f"{out}_before"),
        F.lit(total).cast("bigint").alias(f"{out}_total"),
        *[c for s in sums for c in ((F.col(f"_skip_{s}") + F.col(f"_run_{s}")).alias(s), F.col(f"{s}_total"))])


def positions_of(df: DataFrame, few: Sequence[Row], value: str, key: str, descending: bool = False) -> list[Column]:
    """Aggregates over ``df``: for each of a few rows with ``value`` and ``key`` its position in the order, from 1."""
    kinds = df.schema
    order = order_columns(value, key, descending)
    row = F.struct(*[c.alias(n) for n, c in order.items()])
    out = []
    for one in few:
        v, k = F.lit(one[value]).cast(kinds[value].dataType), F.lit(one[key]).cast(kinds[key].dataType)
        probe = F.struct((v.isNull() if descending else v.isNotNull()).alias("_null"), (-1 - v if descending else v).alias("_value"), k.alias("_key"))
        out.append(F.count_if(row < probe) + 1)
    return out
