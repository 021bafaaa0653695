"""Windows over finished aggregates."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def everything() -> WindowSpec:
    """All rows as one window. Only for frames the size of a calendar, a code list or a top-k;
    customer, product and seller frames use ``martlet.operators.ordered`` instead."""
    return Window.partitionBy()


def running(c: Column | str, order: WindowSpec) -> Column:
    return F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0))


def share_of_all(c: str) -> Column:
    """Percent of the column total over the whole (small) frame."""
    return F.try_divide(100.0 * F.col(c).cast("double"), F.sum(c).over(everything()).cast("double"))
