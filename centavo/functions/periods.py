"""Reporting periods. Every function takes an explicit date; nothing reads a clock."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Period:
    """Calendar period, both ends included."""

    start: dt.date
    end: dt.date
    grain: str = "custom"

    def contains(self, day: Column) -> Column:
        return (day >= F.lit(self.start)) & (day <= F.lit(self.end))

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def shift_months(day: dt.date, months: int) -> dt.date:
    """Add calendar months, clamped to the end of the month."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, min(day.day, last))


def month_period(year: int, month: int) -> Period:
    return Period(
        dt.date(year, month, 1),
        dt.date(year, month, calendar.monthrange(year, month)[1]),
        "month",
    )


def month_of(day: dt.date) -> Period:
    return month_period(day.year, day.month)


def trailing_months(as_of: dt.date, months: int) -> Period:
    return Period(shift_months(as_of, -months), as_of, "trailing_12" if months == 12 else "custom")


def last_days(as_of: dt.date, days: int) -> Period:
    """The `days` days that end on `as_of`."""
    return Period(as_of - dt.timedelta(days=days - 1), as_of)


def previous(period: Period) -> Period:
    """The period of equal length just before."""
    end = period.start - dt.timedelta(days=1)
    return Period(end - dt.timedelta(days=period.days - 1), end)


def prior_year(period: Period) -> Period:
    return Period(shift_months(period.start, -12), shift_months(period.end, -12), period.grain)


def after_months_before(day: Column, as_of: dt.date, months: int) -> Column:
    """Trailing window: after `as_of` less n months, up to `as_of`."""
    return (day > F.lit(shift_months(as_of, -months))) & (day <= F.lit(as_of))


def after_days_before(day: Column, as_of: dt.date, days: int) -> Column:
    """Trailing window: after `as_of` less n days, up to `as_of`."""
    return (day > F.lit(as_of - dt.timedelta(days=days))) & (day <= F.lit(as_of))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def bucket_start(day: Column, grain: str) -> Column:
    """First date of the day, week (Monday), month, quarter or year holding `day`."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    return day if grain == "day" else F.trunc(day, grain)


def fiscal_year(day: Column, start_month: Column | int) -> Column:
    """Year in which the fiscal year holding `day` began."""
    month = start_month if isinstance(start_month, Column) else F.lit(start_month)
    return F.year(F.add_months(day, F.lit(1) - month))


def fiscal_quarter(day: Column, start_month: Column | int) -> Column:
    month = start_month if isinstance(start_month, Column) else F.lit(start_month)
    return F.quarter(F.add_months(day, F.lit(1) - month))
