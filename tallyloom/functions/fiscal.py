"""The fiscal calendar: year N runs from 1 October N-1 to 30 September N; month index 0 is October."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the fiscal months, October first.
MONTH_LABELS = ["ต.ค.", "พ.ย.", "ธ.ค.", "ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย."]


def month_index(month: Column) -> Column:
    """Fiscal index 0..11 of a calendar month 1..12."""
    return F.pmod(month + 2, F.lit(12)).cast("int")


def calendar_month(index: Column) -> Column:
    """Calendar month 1..12 of a fiscal index."""
    return (F.pmod(index + 9, F.lit(12)) + 1).cast("int")


def to_fiscal_order(calendar: Column) -> Column:
    """A 12-slot array from calendar to fiscal order."""
    return F.concat(F.slice(calendar, 10, 3), F.slice(calendar, 1, 9))


def year_of_date(day: Column) -> Column:
    return (F.year(day) + (F.month(day) >= 10).cast("int")).cast("int")


def year_of_int(day: Column) -> Column:
    """Fiscal year of a YYYYMMDD integer."""
    return (F.floor(day / 10000) + (month_of_int(day) >= 10).cast("int")).cast("int")


def month_of_int(day: Column) -> Column:
    return F.pmod(F.floor(day / 100), F.lit(100)).cast("int")


def date_window(fiscal_year: int) -> tuple[dt.date, dt.date]:
    """[first day, first day of the next year)."""
    return dt.date(fiscal_year - 1, 10, 1), dt.date(fiscal_year, 10, 1)


def int_window(fiscal_year: int) -> tuple[int, int]:
    """First and last day as YYYYMMDD, both inside."""
    return (fiscal_year - 1) * 10000 + 1001, fiscal_year * 10000 + 930


def in_dates(day: Column, fiscal_year: int) -> Column:
    """Half-open range on the raw column, so that it reaches the scan."""
    first, end = date_window(fiscal_year)
    return (day >= F.lit(first)) & (day < F.lit(end))


def in_ints(day: Column, fiscal_year: int) -> Column:
    return day.between(*int_window(fiscal_year))


def of_year(rows: DataFrame, in_window: Column, fiscal_year: int) -> DataFrame:
    """The rows of a year: those in its window, and of its partition where rows are laid out by `fy`."""
    return rows.where(in_window & (F.col("fy") == fiscal_year) if "fy" in rows.columns else in_window)


def month_label(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_LABELS]), index + 1)


def current_year() -> Column:
    return year_of_date(F.current_date())


def default_year_of(year: Column, selected: int) -> Column:
    """default_year as an aggregate: of each group's years with data."""
    return F.when(F.coalesce(F.max(year == selected), F.lit(False)), F.lit(selected)).otherwise(F.coalesce(F.max(year), F.lit(selected))).cast("int")


def default_year(available: list[int], selected: int) -> int:
    """The selected year if there is data for it, else the newest; with no data at all, the selected one."""
    return selected if selected in available or not available else max(available)
