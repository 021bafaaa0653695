"""Global order statistics without a global sort in one task.

``OVER (ORDER BY ...)`` over a whole table moves every row to one task. Here the order is taken over
a *histogram*: rows are first aggregated to one row per distinct integer value (combined before the
shuffle, so a value that holds a third of all rows costs one row per task), and running totals are
then built in two levels. The lower level runs inside blocks of 2**BLOCK_BITS neighbouring values,
so no window partition can hold more rows than that; the upper level runs over one total per block.

Values must be BIGINT: money as cents, durations as seconds, dates as days. Results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.operators.ranges import positions

BLOCK_BITS = 20


def _block(c: Column) -> Column:
    return F.shiftright(c, BLOCK_BITS)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL; keeps the left copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def histogram(df: DataFrame, value: str, groups: Sequence[str] = (), sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (groups, value) with ``n`` and any further sums; NULL values are left out."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(a) for a, c in (sums or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*aggs)


def running_before(hist: DataFrame, value: str, weights: Sequence[str], groups: Sequence[str] = (),
                   descending: bool = False) -> DataFrame:
    """Add, per weight ``w``, ``w_before`` (sum over earlier values) and ``w_total``."""
    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    blocked = hist.withColumn("_block", _block(F.col(value)))
    inside = (Window.partitionBy(*groups, "_block").orderBy(direction(value))
              .rowsBetween(Window.unboundedPreceding, -1))
    across_key = Window.partitionBy(*groups)
    across = across_key.orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*groups, "_block").agg(*[F.sum(w).alias(w) for w in weights]).select(
        *groups, "_block",
        *[F.coalesce(F.sum(w).over(across), F.lit(0)).alias(f"_{w}_blocks") for w in weights],
        *[F.sum(w).over(across_key).alias(f"{w}_total") for w in weights])
    local = blocked.withColumns({f"_{w}_inside": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    joined = _null_safe(local, blocks, [*groups, "_block"])
    return joined.select(
        *hist.columns,
        *[(F.col(f"_{w}_blocks") + F.col(f"_{w}_inside")).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights])


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], groups: Sequence[str] = (),
                    unit: int = 1, count_as: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles of an integer column, one row per group.

    ``probs`` maps output names to probabilities; results are divided by ``unit``.
    """
    h = running_before(histogram(df, value, groups), value, ["n"], groups)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    aggs = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("n_total") - 1).cast("double")
        low, high = F.floor(position), F.ceil(position)
        aggs += [F.max(F.when(low.between(first, last), F.col(value))).alias(f"_{name}_low"),
                 F.max(F.when(high.between(first, last), F.col(value))).alias(f"_{name}_high")]
    picked = h.groupBy(*groups).agg(F.max("n_total").alias("_n"), *aggs)
    outs = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        outs.append(((low + (high - low) * (position - F.floor(position))) / F.lit(float(unit))).alias(name))
    counted = [F.col("_n").alias(count_as)] if count_as else []
    return picked.select(*groups, *counted, *outs)


def ntile_at(position: Column, total: Column, tiles: int) -> Column:
    """Tile of a 1-based position when ``total`` rows are split into ``tiles``, larger tiles first."""
    n = F.lit(tiles).cast("bigint")
    small = F.floor(total / n)
    larger = total % n
    split = larger * (small + 1)
    early = F.floor((position - 1) / (small + 1)) + 1
    late = F.floor(F.try_divide(position - 1 - split, small)) + 1 + larger
    return F.when(position <= split, early).otherwise(late).cast("bigint")


def tile_start(tile: Column, total: Column, tiles: int) -> Column:
    """First 1-based position of a tile."""
    small = F.floor(total / F.lit(tiles))
    larger = total % F.lit(tiles)
    done = tile - 1
    return (done * small + F.least(done, larger) + 1).cast("bigint")


def tile_slices(hist: DataFrame, value: str, tiles: int, descending: bool = False) -> DataFrame:
    """Split a histogram into equal-count tiles: one row per (value, tile) with ``in_tile`` rows.

    A value whose copies straddle a tile border is divided between the tiles by count, which is
    what row-wise tiling does to equal rows, so sums and extremes per tile need no row order.
    """
    h = running_before(hist, value, ["n"], descending=descending)
    start, end = F.col("n_before") + 1, F.col("n_before") + F.col("n")
    spread = h.withColumn("tile", F.explode(F.sequence(
        ntile_at(start, F.col("n_total"), tiles), ntile_at(end, F.col("n_total"), tiles))))
    first = tile_start(F.col("tile"), F.col("n_total"), tiles)
    after = tile_start(F.col("tile") + 1, F.col("n_total"), tiles)
    inside = F.least(end + 1, after) - F.greatest(start, first)
    return spread.withColumn("in_tile", inside.cast("bigint"))


def row_positions(df: DataFrame, value: str, key: str, out: str, descending: bool = False, rows: int | None = None) -> DataFrame:
    """1-based position of each row ordered by ``value`` then ``key`` (unique), never in one task.

    Also adds ``<out>_before`` (rows with an earlier value) and ``<out>_total``. NULL is the smallest value and the smallest
    key, so such rows keep a position too. See ``martlet.operators.ranges``.
    """
    return positions(df, value, key, out, descending, rows=rows)


def share_curve(df: DataFrame, value: str, at: Sequence[int] | None = None) -> DataFrame:
    """Concentration curve of a positive integer amount, rows ranked from the largest.

    Returns one row: row count, amount, rows needed for 80% and, per percent ``q`` in ``at``, the
    amount share of the first ``max(floor(rows*q/100), 1)`` rows.
    """
    h = running_before(histogram(df, value).withColumn("amount", F.col("n") * F.col(value)), value,
                       ["n", "amount"], descending=True)
    total = F.col("amount_total").cast("double")
    v, n0, a0 = F.col(value), F.col("n_before"), F.col("amount_before")
    # rows of this value that keep the running share at or below 80%
    room = F.floor((F.lit(0.8) * total - a0.cast("double")) / F.greatest(v, F.lit(1)).cast("double") + F.lit(1e-9))
    within = F.greatest(F.least(room, F.col("n")), F.lit(0))
    rank = {q: F.greatest(F.floor(F.col("n_total") * q / 100), F.lit(1)) for q in (at or [])}
    picks = [
        F.max(F.when(r.between(n0 + 1, n0 + F.col("n")),
                     F.lit(100.0) * (a0 + (r - n0) * v).cast("double") / total)).alias(f"share_{q}")
        for q, r in rank.items()]
    return h.agg(F.max("n_total").alias("rows"), F.max("amount_total").alias("amount"),
                 F.least(F.sum(within) + 1, F.max("n_total")).alias("rows_for_80pct"), *picks)
