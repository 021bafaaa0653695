"""Figures of a table in one scan: counts, sums and extremes together with what its keys say.

An audit names the figures it wants from a frame. Without keys they are one aggregation. With keys the frame is grouped by
all of them at once (grouping sets over one scan), each group carries the partial figures, and a second aggregation merges
them; a key value that very many rows share is one row per task after the first, map-side step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Figure:
    """A value that merges from the values of parts: how a part is summed up, and how parts are."""

    part: Column
    merge: str = "sum"

    def whole(self, cell: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.merge](cell)


def rows() -> Figure:
    return Figure(F.count(F.lit(1)))


def count_where(cond: Column) -> Figure:
    return Figure(F.count_if(cond))


def amount(column: Column | str) -> Figure:
    return Figure(F.sum(column))


def lowest(column: Column | str) -> Figure:
    return Figure(F.min(column), "min")


def highest(column: Column | str) -> Figure:
    return Figure(F.max(column), "max")


@dataclass(frozen=True)
class Audit:
    """The figures of a frame, and its keys: key k gives ``k.surplus`` (rows that repeat a key) and ``k.distinct``.

    A key that is NULL in any column counts as repeated like any other, but is not a distinct key.
    """

    frame: DataFrame
    figures: Mapping[str, Figure] = field(default_factory=dict)
    keys: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def row(self) -> DataFrame:
        """One row with a column per figure, `0` for sums over no rows and NULL for extremes over none."""
        if not self.keys:
            return self.frame.agg(*[self._filled(f, f.part).alias(name) for name, f in self.figures.items()])
        columns = list(dict.fromkeys(c for key in self.keys.values() for c in key))
        sets = {name: _set_id(columns, key) for name, key in self.keys.items()}
        partials = [F.count(F.lit(1)).alias("_rows"), *[f.part.alias(f"_part_{i}") for i, f in enumerate(self.figures.values())]]
        if len(set(sets.values())) == 1:
            groups = self.frame.groupBy(*[F.col(f"`{c}`").alias(f"_key_{i}") for i, c in enumerate(columns)]).agg(*partials).withColumn("_set", F.lit(0))
        else:
            groups = self.frame.groupingSets([[F.col(f"`{c}`") for c in key] for key in {sets[n]: k for n, k in self.keys.items()}.values()],
                                             *[F.col(f"`{c}`") for c in columns]).agg(*partials, F.grouping_id().alias("_set"))
            groups = groups.toDF(*[f"_key_{i}" for i in range(len(columns))], *groups.columns[len(columns):])
        first = F.col("_set") == next(iter(sets.values()))
        out = [self._filled(f, f.whole(F.when(first, F.col(f"_part_{i}")))).alias(name) for i, (name, f) in enumerate(self.figures.items())]
        for name, key in self.keys.items():
            here = F.col("_set") == sets[name]
            known = reduce(lambda a, b: a & b, [F.col(f"_key_{columns.index(c)}").isNotNull() for c in key])
            out += [F.coalesce(F.sum(F.when(here, F.col("_rows") - 1)), F.lit(0)).alias(f"{name}.surplus"), F.count_if(here & known).alias(f"{name}.distinct")]
        return groups.agg(*out)

    @staticmethod
    def _filled(figure: Figure, value: Column) -> Column:
        return F.coalesce(value, F.lit(0)) if figure.merge == "sum" else value


def _set_id(columns: Sequence[str], key: Sequence[str]) -> int:
    """The grouping id of a key: a bit for each column it lacks, the first column highest; 0 where it has all."""
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in key)


def figures(audits: Mapping[str, Audit]) -> DataFrame:
    """All figures as (table, figure, value as text), one scan per audit."""
    frames = []
    for table, audit in audits.items():
        row = audit.row()
        cells = [F.struct(F.lit(c).alias("figure"), F.col(f"`{c}`").cast("string").alias("value")) for c in row.columns]
        frames.append(row.select(F.lit(table).alias("table"), F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, frames)


#: A figure by table and name, or a constant.
Reference = tuple[str, str] | int


def compare(audits: Mapping[str, Audit], checks: Sequence[tuple[str, Reference, Reference]]) -> DataFrame:
    """Checks that two figures are equal: check, result (PASS or FAIL), detail. A figure that is NULL fails."""
    named = F.struct(F.concat_ws(".", "table", "figure"), F.col("value"))
    found = figures(audits).agg(F.map_from_entries(F.collect_list(named)).alias("found"))  # as many as the audits name

    def text(what: Reference) -> Column:
        return F.lit(str(what)) if isinstance(what, int) else F.col("found")[".".join(what)]

    def row(name: str, got: Column, want: Column) -> Column:
        same = got.cast("decimal(38,6)") == want.cast("decimal(38,6)")
        return F.struct(F.lit(name).alias("check"), F.when(same, "PASS").otherwise("FAIL").alias("result"),
                        F.concat(F.coalesce(got, F.lit("NULL")), F.lit(" == "), F.coalesce(want, F.lit("NULL"))).alias("detail"))
    return found.select(F.inline(F.array(*[row(name, text(got), text(want)) for name, got, want in checks])))
