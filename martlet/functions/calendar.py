"""Calendar columns, durations and month arithmetic."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlet.functions.numbers import col

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def parse_ts(c: Column | str, dtype: str) -> Column:
    """Timestamp from text; text that is no timestamp becomes NULL. Typed columns pass through."""
    return F.try_to_timestamp(col(c)) if dtype == "string" else col(c)


def month_label(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def quarter_label(ts: Column | str) -> Column:
    return F.concat(F.year(col(ts)).cast("string"), F.lit("Q"), F.quarter(col(ts)).cast("string"))


def day_name(ts: Column | str) -> Column:
    return F.date_format(col(ts), "EEEE")


def weekday_number(ts: Column | str) -> Column:
    """Monday is 1."""
    return F.weekday(col(ts)) + 1


def month_index(ts: Column | str) -> Column:
    return F.year(col(ts)) * 12 + F.month(col(ts))


def month_from_index(index: Column | str) -> Column:
    zero_based = col(index) - 1
    return F.format_string("%d-%02d", F.floor(zero_based / 12).cast("int"),
                           (F.pmod(zero_based, F.lit(12)) + 1).cast("int"))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional days, from whole microseconds."""
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / F.lit(86_400_000_000.0)


def whole_days_to(reference: date, ts: Column | str) -> Column:
    """Full days left until midnight of ``reference`` (floors a timestamp difference)."""
    micros = F.timestamp_diff("MICROSECOND", col(ts), F.lit(reference).cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("bigint")


def dates_to(reference: date, day: Column | str) -> Column:
    """Calendar days until ``reference``."""
    return F.date_diff(F.lit(reference), col(day)).cast("bigint")


def in_dates(ts: Column | str, first: date | None, last: date | None) -> Column:
    """``first <= ts`` and ``ts`` before the end of ``last``; either bound may be open."""
    from datetime import timedelta

    cond = F.lit(True)
    if first is not None:
        cond = cond & (col(ts) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        cond = cond & (col(ts) < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))
    return cond


def is_truncated(day: Column | str, cutoff: date, inclusive: bool = False) -> Column:
    """Days after the cutoff; with ``inclusive`` the cutoff day itself counts as truncated."""
    d = F.to_date(col(day))
    return d >= F.lit(cutoff) if inclusive else d > F.lit(cutoff)
