"""Row conditions on timestamps.

Conditions on a calendar day, month or year are written as half-open ranges on
the bare column, so that Parquet row groups outside the range are never read.
Where a table is partitioned by month, ``month_column`` names its partition
column (the first day of the month, as DATE): the same range is then put on it
as well, and whole partitions are left out.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_bounds(period: str) -> tuple[date, date]:
    """First day of ``2006``, ``2006-02`` or ``2006-02-14``, and the day after it."""
    numbers = [int(number) for number in period.split("-")]
    if len(numbers) == 1:
        return date(numbers[0], 1, 1), date(numbers[0] + 1, 1, 1)
    if len(numbers) == 2:
        year, month = numbers
        return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)
    first = date(*numbers)
    return first, first + timedelta(days=1)


def inside_range(column: str, first: date, after: date) -> Column:
    return (F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(after))


def outside_range(column: str, first: date, after: date, keep_missing: bool) -> Column:
    condition = (F.col(column) < F.lit(first)) | (F.col(column) >= F.lit(after))
    return condition | F.col(column).isNull() if keep_missing else condition


def within_days(
    condition: Column, first: date, after: date, month_column: str | None
) -> Column:
    """The condition, and the months its days lie in."""
    if month_column is None:
        return condition
    month_after = period_bounds((after - timedelta(days=1)).isoformat()[:7])[1]
    return condition & inside_range(month_column, first.replace(day=1), month_after)


def within(when: str, period: str, month_column: str | None = None) -> Column:
    """In the day, month or year; NULL for a missing timestamp."""
    first, after = period_bounds(period)
    condition = inside_range(when, first, after)
    return within_days(condition, first, after, month_column)


def outside(
    when: str,
    period: str,
    keep_missing: bool = False,
    month_column: str | None = None,
) -> Column:
    """Not in the day, month or year.

    A missing timestamp fails the condition, as ``!=`` does in SQL; with
    ``keep_missing`` it passes, as a negated mask does on a client frame.
    """
    first, after = period_bounds(period)
    condition = outside_range(when, first, after, keep_missing)
    whole_months = first.day == after.day == 1
    if month_column is None or not whole_months:
        return condition
    return condition & outside_range(month_column, first, after, keep_missing)


def between_texts(
    when: str, low: str, high: str, month_column: str | None = None
) -> Column:
    """``BETWEEN`` with text bounds: of the day ``high`` only midnight is inside."""
    condition = F.col(when).between(F.lit(low), F.lit(high))
    if month_column is None:
        return condition
    first, after = period_bounds(low[:10])[0], period_bounds(high[:10])[1]
    return within_days(condition, first, after, month_column)


def whole_days(
    when: str, first_day: str, last_day: str, month_column: str | None = None
) -> Column:
    """All of both border days and everything between them."""
    first, after = period_bounds(first_day)[0], period_bounds(last_day)[1]
    condition = inside_range(when, first, after)
    return within_days(condition, first, after, month_column)


def in_slot(when: str, day: int, hour: int) -> Column:
    """A day of month and an hour, in any month."""
    return (F.dayofmonth(F.col(when)) == day) & (F.hour(F.col(when)) == hour)
