"""Business definitions shared by every job.

All of them are parameters; the defaults are the published ones. A job never spells out a date,
status or threshold itself, it asks the ``Definitions`` it was given.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field
from datetime import date, timedelta

_MONTHS = [m.lower() for m in calendar.month_abbr]


def _shift_month(year: int, month: int, by: int) -> tuple[int, int]:
    index = year * 12 + (month - 1) + by
    return index // 12, index % 12 + 1


@dataclass(frozen=True)
class MonthSpan:
    """A run of whole months, e.g. the last quarter of the window."""

    months: tuple[str, ...]

    @property
    def tag(self) -> str:
        first, last = self.months[0], self.months[-1]
        return f"{_MONTHS[int(first[5:])]}_{_MONTHS[int(last[5:])]}_{last[:4]}"


@dataclass(frozen=True)
class Definitions:
    # Published business definitions.
    realised_statuses: tuple[str, ...] = ("delivered",)
    window_start: date = date(2017, 1, 1)
    window_end: date = date(2018, 8, 31)
    truncation_cutoff: date = date(2018, 8, 23)
    shipping_limit_from: date = date(2016, 9, 1)
    shipping_limit_to: date = date(2018, 12, 31)
    latitude_box: tuple[float, float] = (-33.75, 5.27)
    longitude_box: tuple[float, float] = (-73.99, -34.79)
    active_days: int = 90
    lapse_quantile: float = 0.90
    high_value_quantile: float = 0.80
    min_group: int = 30
    alpha: float = 0.05
    min_orders_per_state: int = 500
    min_units_per_category: int = 100
    min_freight_units: int = 500
    min_state_revenue: int = 100_000
    momentum_floor: int = 20_000
    trend_from_month: str = "2018-03"
    currency: str = "R$"
    price_edges: tuple[int, ...] = (25, 50, 100, 200, 500, 1000)
    compared_payments: tuple[str, str] = ("credit_card", "boleto")
    instalment_payment: str = "credit_card"
    undefined_payment: str = "not_defined"
    manual_translations: dict[str, str] = field(default_factory=lambda: {
        "pc_gamer": "pc_gamer",
        "portateis_cozinha_e_preparadores_de_alimentos": "kitchen_portables_and_food_preparers",
    })

    @property
    def recency_date(self) -> date:
        """The day after the window closes, so that recency is never negative."""
        return self.window_end + timedelta(days=1)

    @property
    def window_end_exclusive(self) -> date:
        return self.window_end + timedelta(days=1)

    @property
    def comparable_months(self) -> int:
        """Months 1..n that every year of the window covers."""
        return self.window_end.month

    @property
    def last_month(self) -> str:
        return f"{self.window_end:%Y-%m}"

    @property
    def last_age(self) -> int:
        """Months from the window's first month to its last: the highest age that a cohort can have."""
        return self.last_month_index - (self.window_start.year * 12 + self.window_start.month)

    @property
    def last_month_index(self) -> int:
        return self.window_end.year * 12 + self.window_end.month

    def _span(self, back: int) -> MonthSpan:
        cells = [_shift_month(self.window_end.year, self.window_end.month, -k)
                 for k in range(back + 2, back - 1, -1)]
        return MonthSpan(tuple(f"{y:04d}-{m:02d}" for y, m in cells))

    @property
    def recent_span(self) -> MonthSpan:
        return self._span(0)

    @property
    def prior_span(self) -> MonthSpan:
        return self._span(3)

    @property
    def partial_month(self) -> str | None:
        """The month the extract stops in, when it stops before the month does."""
        cut = self.truncation_cutoff
        last_day = calendar.monthrange(cut.year, cut.month)[1]
        return f"{cut:%Y-%m}" if cut.day < last_day else None

    @property
    def partial_quarter(self) -> tuple[str, str] | None:
        """(quarter label, months it does cover) when the window closes inside a quarter."""
        end = self.window_end
        if end.month % 3 == 0 and end.day == calendar.monthrange(end.year, end.month)[1]:
            return None
        quarter = (end.month - 1) // 3 + 1
        first = 3 * (quarter - 1) + 1
        covered = "+".join(calendar.month_abbr[k] for k in range(first, end.month + 1))
        return f"{end.year}Q{quarter}", covered
