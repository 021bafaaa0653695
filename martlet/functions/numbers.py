"""Money, ratios and counts.

Money is DECIMAL(18,2): sums are exact and do not depend on how rows are partitioned. Ratios are
doubles made from finished sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    return col(c).cast(MONEY)


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def big(c: Column | str) -> Column:
    return col(c).cast("bigint")


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(dbl(num), dbl(den))


def pct(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(F.lit(100.0) * dbl(num), dbl(den))


def rounded_pct(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    return F.round(pct(num, den), digits)


def cents_per(amount: Column | str, n: Column | str) -> Column:
    """Money per unit to two digits, half to even, exact in decimals."""
    exact = F.try_divide(col(amount).cast("decimal(24,6)"), col(n).cast("decimal(12,0)"))
    return F.bround(exact, 2).cast("double")


def growth_pct(now: Column | str, before: Column | str) -> Column:
    return F.try_divide(F.lit(100.0) * (dbl(now) - dbl(before)), dbl(before))


def total(c: Column | str) -> Column:
    """Exact decimal sum, as a double."""
    return F.sum(col(c)).cast("double")


def mean(c: Column | str) -> Column:
    """Average of the non-null values, from an exact sum and a count."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)).cast("double"))


def share_true(flag: Column | str) -> Column:
    """Share of true among non-null flags."""
    return F.avg(col(flag).cast("int"))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def sum_where(cond: Column, c: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(cond, col(c))), F.lit(0)).cast("double")


def cents(c: Column | str) -> Column:
    """Money as whole cents, the integer domain of the exact order statistics."""
    return (money(c) * 100).cast("bigint")


def scalar(df: DataFrame, *names: str) -> Column:
    """One-row frame as a struct-valued scalar subquery: runs once, joins nothing."""
    return df.select(F.struct(*names).alias("one")).scalar()


def fetched(df: DataFrame, *names: str) -> dict[str, Column]:
    """One-row frame of thresholds as literals.

    Runs a job now and brings exactly one row of numbers to the driver. Used where a threshold
    enters many expressions, which a scalar subquery would repeat in the plan.
    """
    row = df.select(*names).first()
    return {n: F.lit(None if row is None else row[n]).cast("double") for n in names}
