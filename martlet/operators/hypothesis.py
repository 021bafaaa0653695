"""Hypothesis tests from distributed sufficient statistics, for every stratum at once.

Each test is one grouped aggregation; only its finished row meets the tail functions. A stratum
with a group below the minimum size, or with an empty cell, gives NULL statistics and
``insufficient_data``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions.tails import chi2_p, normal_p, t_critical, t_p
from martlet.operators.ordered import histogram, running_before

MIN_GROUP = 30
ALPHA = 0.05
Z95 = 1.96  # published two-sided 95% point used for differences of proportions


def _guard(df: DataFrame, small: Column, keep: Sequence[str]) -> DataFrame:
    """Blank every statistic of a stratum that is too small."""
    flag = F.coalesce(small, F.lit(True))
    stats = {c: F.when(~F.col("insufficient_data"), F.col(c)) for c in df.columns if c not in keep}
    return df.withColumn("insufficient_data", flag).withColumns(stats)


def _verdict(df: DataFrame, p: str, alpha: float) -> DataFrame:
    # Decision wording.
    return df.withColumn("decision", F.when(F.col(p) < alpha, "reject H0").when(F.col(p).isNotNull(), "fail to reject H0"))


def welch(df: DataFrame, value: Column, group: Column, first: str, second: str, strata: Sequence[str] = (),
          min_group: int = MIN_GROUP, alpha: float = ALPHA) -> DataFrame:
    """Two-sample t-test with unequal variances: first minus second, interval, Cohen's d."""
    x = value.cast("double")
    a, b = (F.when(group == name, x) for name in (first, second))
    base = df.where(group.isin(first, second) & x.isNotNull())
    s = base.groupBy(*strata).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
        F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    n1, n2, v1, v2 = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("v1"), F.col("v2")
    e1, e2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    stats = s.select(
        *strata, "n1", "n2", "mean1", "mean2", "v1", "v2",
        (F.col("mean1") - F.col("mean2")).alias("difference"), F.sqrt(e1 + e2).alias("se"),
        F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1)).alias("dof"),
        pooled.alias("pooled_sd"))
    stats = stats.withColumns({"t": F.try_divide(F.col("difference"), F.col("se")),
                               "cohens_d": F.try_divide(F.col("difference"), F.col("pooled_sd"))})
    small = F.least("n1", "n2") < min_group
    guarded = _guard(stats, small, [*strata, "n1", "n2", "mean1", "mean2"])
    reach = F.col("se") * t_critical(F.when(F.col("dof").isNotNull(), F.lit(alpha)), F.col("dof"))
    done = guarded.withColumns({"p_value": t_p("t", "dof"), "reach": reach})
    return _verdict(done.withColumns({"ci_low": F.col("difference") - F.col("reach"),
                                      "ci_high": F.col("difference") + F.col("reach")}).drop("reach", "v1", "v2", "se"),
                    "p_value", alpha)


def welch_log(df: DataFrame, value: Column, group: Column, first: str, second: str, strata: Sequence[str] = (),
              min_group: int = MIN_GROUP) -> DataFrame:
    """The same on logarithms of positive values, with the ratio of geometric means."""
    positive = F.when(value > 0, F.log(value.cast("double")))
    return welch(df, positive, group, first, second, strata, min_group).withColumn(
        "geometric_mean_ratio", F.exp("difference"))


def mann_whitney(df: DataFrame, value: str, group: str, first: str, second: str, strata: Sequence[str] = ()) -> DataFrame:
    """U of the first group against the second, tie- and continuity-corrected normal p-value.

    ``value`` is an integer column (money as cents). Ranks come from the joint value histogram:
    equal values share their average rank, and no row is ever sorted.
    """
    base = df.where(F.col(group).isin(first, second))
    h = histogram(base, value, strata, {"n1": (F.col(group) == first).cast("bigint")})
    ranked = running_before(h, value, ["n"], strata)
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    average = F.col("n_before") + (n + 1) / 2.0
    s = ranked.groupBy(*strata).agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"),
                                    F.sum(n1 * average).alias("r1"), F.sum(n * n * n - n).alias("ties"))
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    both = a + b
    spread = F.sqrt(a * b / 12.0 * ((both + 1) - F.try_divide(F.col("ties"), both * (both - 1))))
    s = s.withColumn("u", F.col("r1") - a * (a + 1) / 2.0).withColumn("sd", spread)
    larger = F.greatest(F.col("u"), a * b - F.col("u"))
    z = F.try_divide(larger - a * b / 2.0 - 0.5, F.col("sd"))
    out = s.select(*strata, "n1", "n2", "u", z.alias("z"),
                   (F.lit(1.0) - F.try_divide(2.0 * F.col("u"), a * b)).alias("rank_biserial"))
    return out.withColumn("p_value", F.least(normal_p("z"), F.lit(1.0)))


def contingency(df: DataFrame, a: str, b: str, strata: Sequence[str] = ()) -> DataFrame:
    """Cell counts with margins. Only observed cells; margins make the rest."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*strata, a, b).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*strata)
    return cells.withColumns({
        "row_n": F.sum("n").over(Window.partitionBy(*strata, a)), "col_n": F.sum("n").over(Window.partitionBy(*strata, b)),
        "all_n": F.sum("n").over(whole), "row_at": F.row_number().over(Window.partitionBy(*strata, a).orderBy(b)),
        "col_at": F.row_number().over(Window.partitionBy(*strata, b).orderBy(a))})


def chi_square(df: DataFrame, a: str, b: str, strata: Sequence[str] = (), yates: bool = True) -> DataFrame:
    """Independence of two categorical columns and Cramer's V.

    The continuity correction applies to 2 x 2 tables. Cells that never occur contribute their
    expected count, which is what is left of the total.
    """
    cells = contingency(df, a, b, strata)
    n, expected = F.col("n").cast("double"), F.col("row_n").cast("double") * F.col("col_n") / F.col("all_n")
    gap = F.abs(n - expected)
    corrected = F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))
    s = cells.groupBy(*strata).agg(
        F.count_if(F.col("row_at") == 1).alias("rows"), F.count_if(F.col("col_at") == 1).alias("cols"),
        F.max("all_n").alias("n"), F.sum(gap * gap / expected).alias("plain"),
        F.sum(corrected * corrected / expected).alias("fixed"), F.sum(expected).alias("seen_expected"),
        F.count(F.lit(1)).alias("cells"))
    two_by_two = (F.col("rows") == 2) & (F.col("cols") == 2)
    unseen = F.col("n") - F.col("seen_expected")
    # in a 2 x 2 table every cell is equally far from its expectation, so unseen cells share theirs
    each = F.try_divide(unseen, (4 - F.col("cells")).cast("double"))
    trimmed = each - F.least(each, F.lit(0.5))
    unseen_fixed = F.coalesce((4 - F.col("cells")) * F.try_divide(trimmed * trimmed, each), F.lit(0.0))
    stat = F.when(two_by_two & F.lit(yates), F.col("fixed") + unseen_fixed).otherwise(F.col("plain") + unseen)
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    out = s.select(*strata, "n", stat.alias("chi2"), dof.cast("bigint").alias("dof"),
                   F.least("rows", "cols").alias("k"), "cells")
    return out.withColumn("cramers_v", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.col("k") - 1)))).withColumn(
        "p_value", F.when(F.col("dof") > 0, chi2_p("chi2", F.col("dof").cast("double")))).drop("k", "cells")


def risk_difference(df: DataFrame, exposed: Column, outcome: Column, strata: Sequence[str] = (),
                    min_group: int = MIN_GROUP, alpha: float = ALPHA) -> DataFrame:
    """Outcome rate when exposed against not: chi-square, difference with interval, risk ratio."""
    flags = df.select(*strata, F.coalesce(exposed, F.lit(False)).alias("x"), outcome.alias("y")).na.drop(subset=["y"])
    s = flags.groupBy(*strata).agg(
        F.count_if(F.col("x")).alias("n_exposed"), F.count_if(~F.col("x")).alias("n_other"),
        F.count_if(F.col("x") & F.col("y")).alias("k1"), F.count_if(~F.col("x") & F.col("y")).alias("k0"))
    n1, n0, k1, k0 = (F.col(c).cast("double") for c in ("n_exposed", "n_other", "k1", "k0"))
    p1, p0 = F.try_divide(k1, n1), F.try_divide(k0, n0)
    whole, hits = n1 + n0, k1 + k0
    cells = [(k1, n1 * hits / whole), (n1 - k1, n1 * (whole - hits) / whole), (k0, n0 * hits / whole),
             (n0 - k0, n0 * (whole - hits) / whole)]
    parts = []
    for seen, expected in cells:
        gap = F.abs(seen - expected)
        kept = gap - F.least(gap, F.lit(0.5))
        parts.append(F.try_divide(kept * kept, expected))
    se = F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    empty = reduce(or_, [seen == 0 for seen, _ in cells])
    stats = s.where(whole > 0).select(
        *strata, "n_exposed", "n_other", p1.alias("rate_exposed"), p0.alias("rate_other"),
        F.when(~empty, sum(parts[1:], parts[0])).alias("chi2"), (p1 - p0).alias("difference"),
        F.when((n1 > 0) & (n0 > 0), se).alias("se"), F.try_divide(p1, p0).alias("risk_ratio"), empty.alias("empty"))
    small = (F.least("n_exposed", "n_other") < min_group) | F.col("empty")
    guarded = _guard(stats, small, [*strata, "n_exposed", "n_other", "rate_exposed", "rate_other", "empty"])
    done = guarded.withColumns({
        "cramers_v": F.sqrt(F.col("chi2") / (F.col("n_exposed") + F.col("n_other"))),
        "ci_low": F.col("difference") - Z95 * F.col("se"), "ci_high": F.col("difference") + Z95 * F.col("se"),
        "p_value": chi2_p("chi2", F.when(F.col("chi2").isNotNull(), F.lit(1.0)))})
    return _verdict(done.drop("se", "empty"), "p_value", alpha)


def two_proportions(df: DataFrame, exposed: Column, outcome: Column, strata: Sequence[str] = (),
                    min_group: int = MIN_GROUP, alpha: float = ALPHA) -> DataFrame:
    """Two-proportion z-test with interval and Cohen's h."""
    flags = df.select(*strata, F.coalesce(exposed, F.lit(False)).alias("x"), outcome.alias("y")).na.drop(subset=["y"])
    s = flags.groupBy(*strata).agg(
        F.count_if(F.col("x")).alias("n_exposed"), F.count_if(~F.col("x")).alias("n_other"),
        F.count_if(F.col("x") & F.col("y")).alias("k1"), F.count_if(~F.col("x") & F.col("y")).alias("k0"))
    n1, n0, k1, k0 = (F.col(c).cast("double") for c in ("n_exposed", "n_other", "k1", "k0"))
    p1, p0, pooled = F.try_divide(k1, n1), F.try_divide(k0, n0), F.try_divide(k1 + k0, n1 + n0)
    apart = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    se = F.sqrt(F.try_divide(p1 * (1 - p1), n1) + F.try_divide(p0 * (1 - p0), n0))
    stats = s.select(*strata, "n_exposed", "n_other", p1.alias("rate_exposed"), p0.alias("rate_other"),
                     (p1 - p0).alias("difference"), F.try_divide(p1 - p0, apart).alias("z"), se.alias("se"),
                     (2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p0))).alias("cohens_h"), (k1 + k0 == 0).alias("none"))
    small = (F.least("n_exposed", "n_other") < min_group) | F.col("none")
    guarded = _guard(stats, small, [*strata, "n_exposed", "n_other", "rate_exposed", "rate_other", "none"])
    done = guarded.withColumns({"ci_low": F.col("difference") - Z95 * F.col("se"),
                                "ci_high": F.col("difference") + Z95 * F.col("se"), "p_value": normal_p("z")})
    return _verdict(done.drop("se", "none"), "p_value", alpha)


def detectable_effect(tested: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Smallest Cohen's d found with 80% power, and the same in units of the value.

    Input is a ``welch`` result.
    """
    power = 1.96 + 0.84  # published: two-sided 5% point plus 80% power point
    mde = power * F.sqrt(F.try_divide(F.lit(1.0), F.col("n1").cast("double")) + F.try_divide(F.lit(1.0), F.col("n2").cast("double")))
    return tested.where(~F.col("insufficient_data")).select(
        *strata, "n1", "n2", mde.alias("min_detectable_d"), (mde * F.col("pooled_sd")).alias("min_detectable_difference"),
        F.col("cohens_d").alias("observed_d"), F.col("difference").alias("observed_difference"))
