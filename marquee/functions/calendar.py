"""Calendar parts of a timestamp.

Facts are grouped by integers and dates; the text forms (month name, weekday
name) are put on the few aggregated rows, never on the facts. Everything goes
through ``DATE`` first, so that a ``TIMESTAMP_NTZ`` column never passes through
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English weekday names, Monday first.
WEEKDAYS = (
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
)

# Date format marks in use and the Spark patterns for them.
FORMAT_MARKS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%W": "EEEE"}


def day_of(when: Column) -> Column:
    return F.to_date(when)


def month_start(when: Column) -> Column:
    """First day of the month, as a DATE: sorts in time order, 4 bytes to shuffle."""
    return F.trunc(F.to_date(when), "MM")


def weekday_number(when: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(F.to_date(when))


def weekday_name(number: Column) -> Column:
    """Name of a weekday number, NULL for NULL.

    The guard is needed: on literal arrays ``element_at`` takes a NULL index for
    a number.
    """
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    return F.when(number.isNotNull(), F.element_at(names, number + 1))


def month_text(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def date_text(when: Column, marks: str) -> Column:
    """Text of a date in the ``%Y-%m-%d`` / ``%W`` notation."""
    pattern = marks
    for mark, spark_pattern in FORMAT_MARKS.items():
        pattern = pattern.replace(mark, spark_pattern)
    if "%" in pattern:
        raise ValueError(f"unknown mark in date format {marks!r}")
    return F.date_format(F.to_date(when), pattern)


def parse_date(text: Column) -> Column:
    """DATE from ``yyyy-MM-dd`` text, NULL where the text is no date."""
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_timestamp(text: Column) -> Column:
    """Timestamp without zone from text, NULL where the text is none."""
    return text.try_cast("timestamp_ntz")


def parse_month(text: Column) -> Column:
    """First day of a ``yyyy-MM`` text month, NULL where the text is no month."""
    return parse_date(F.concat(text, F.lit("-01")))


def days_in_month(month: Column) -> Column:
    return F.dayofmonth(F.last_day(month))


def as_utc(naive: Column) -> Column:
    """TIMESTAMP of a naive timestamp read as UTC, whatever the session zone is."""
    hours = F.unix_date(F.to_date(naive)).cast("bigint") * 24 + F.hour(naive)
    minutes = hours * 60 + F.minute(naive)
    in_minute = (F.date_part(F.lit("SECOND"), naive) * 1_000_000).cast("bigint")
    return F.timestamp_micros(minutes * 60_000_000 + in_minute)


def hour_from_utc(instant: Column) -> Column:
    """Naive timestamp of the full hour an instant lies in, read as UTC."""
    hours = F.floor(F.unix_seconds(instant) / 3600)
    day = F.date_from_unix_date(F.floor(hours / 24).cast("int"))
    return F.make_timestamp_ntz(
        F.year(day),
        F.month(day),
        F.dayofmonth(day),
        F.pmod(hours, F.lit(24)).cast("int"),
        F.lit(0),
        F.lit(0).cast("decimal(16,6)"),
    )


def field(value: Column, *options: str) -> Column:
    """1-based place of ``value`` among ``options``; 0 if absent or NULL."""
    listed = F.array(*[F.lit(option) for option in options])
    return F.coalesce(F.array_position(listed, value), F.lit(0).cast("bigint"))


# Grouping keys by name; all are INT or DATE.
PARTS = {
    "rental_day": day_of,
    "month": month_start,
    "year": F.year,
    "day": F.dayofmonth,
    "hour": F.hour,
    "weekday_no": weekday_number,
}
