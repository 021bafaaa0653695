"""Bands and labels: right-closed bins, price bands, quadrants, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlet.functions.numbers import col


def right_closed(c: Column | str, edges: Sequence[float], labels: Sequence) -> Column:
    """Bins ``(edge[i], edge[i+1]]``; values outside all bins and NULL give NULL."""
    x = col(c)
    out = F.when(x <= edges[0], None)
    for upper, label in zip(edges[1:], labels):
        out = out.when(x <= upper, F.lit(label))
    return out


def price_band(c: Column | str, edges: Sequence[int], currency: str) -> Column:
    """Left-closed bands with sortable labels ``a. under X`` ... ``g. Z+``."""
    x = col(c)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = F.when(x < edges[0], F.lit(f"a. under {currency}{edges[0]}"))
    for i in range(1, len(edges)):
        out = out.when(x < edges[i], F.lit(f"{letters[i]}. {currency}{edges[i - 1]}-{edges[i]}"))
    return out.otherwise(F.lit(f"{letters[len(edges)]}. {currency}{edges[-1]}+"))


# Instalment band labels of the query pack and of the notebook table.
QUERY_INSTALMENT_LABELS = ["a. paid in full (1x)", "b. 2-3x", "c. 4-6x", "d. 7-10x", "e. 11x or more"]
TABLE_INSTALMENT_LABELS = ["1x (paid in full)", "2-3x", "4-6x", "7-10x", "11x+"]
INSTALMENT_EDGES = [0, 1, 3, 6, 10, 100]


def query_instalment_band(c: Column | str) -> Column:
    """The last band also takes zero and missing counts."""
    x = col(c)
    one, few, some, many, rest = QUERY_INSTALMENT_LABELS
    return (F.when(x == 1, one).when(x.between(2, 3), few).when(x.between(4, 6), some)
            .when(x.between(7, 10), many).otherwise(rest))


def table_instalment_band(c: Column | str) -> Column:
    """Right-closed bins; zero, missing and beyond 100 give NULL."""
    return right_closed(c, INSTALMENT_EDGES, TABLE_INSTALMENT_LABELS)


def frequency_score(orders: Column | str) -> Column:
    """Rule score: three or more orders 5, two orders 3, otherwise 1."""
    n = col(orders)
    return F.when(n >= 3, 5).when(n == 2, 3).otherwise(1).cast("bigint")


def edge_score(c: Column | str, edges: Sequence[Column], reverse: bool = False) -> Column:
    """Score 1..len(edges)+1 by inner quantile edges: right-closed, equal values together."""
    above = F.lit(0)
    for edge in edges:
        above = above + (col(c).cast("double") > edge).cast("int")
    score = F.lit(len(edges) + 1) - above if reverse else above + 1
    return score.cast("bigint")


def quadrant(premium: Column, high_volume: Column, labels: dict) -> Column:
    """Label by the two halves of price and volume."""
    return (F.when(premium & high_volume, labels[True, True]).when(premium, labels[True, False])
            .when(high_volume, labels[False, True]).otherwise(labels[False, False]))
