"""Counts per calendar part.

The facts are combined in the map tasks, so what is shuffled is one row per
task and calendar slot however many rows a slot holds. All reports here also
take an ``HourCube`` in place of the facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from marquee.functions import PARTS, date_text, month_text, weekday_name
from marquee.operators.periods import in_slot, within


@dataclass(frozen=True)
class HourCube:
    """An hour cube read back, in the place of the facts it was made of.

    ``counted`` is the column whose values ``id_count`` counts.
    """

    frame: DataFrame
    counted: str = "rental_id"

    @property
    def sparkSession(self) -> SparkSession:
        return self.frame.sparkSession

    def where(self, condition: Column | str) -> HourCube:
        return HourCube(self.frame.where(condition), self.counted)

    def withColumns(self, columns: dict[str, Column]) -> DataFrame:
        return self.frame.withColumns(columns)

    def groupBy(self, *keys: Column | str) -> GroupedData:
        return self.frame.groupBy(*keys)

    def number(self, counted: str | None, kept: Column | None) -> Column:
        if counted not in (None, self.counted):
            raise ValueError(f"this hour cube does not count {counted!r}")
        value = F.col("row_count" if counted is None else "id_count")
        if kept is not None:
            value = F.when(kept, value)
        return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))


Facts = DataFrame | HourCube


def number_of(
    facts: Facts, counted: str | None = None, kept: Column | None = None
) -> Column:
    """Aggregate: number of rows, or of rows with a value in ``counted``, among the
    ``kept`` ones."""
    if isinstance(facts, HourCube):
        return facts.number(counted, kept)
    value = F.lit(1) if counted is None else F.col(counted)
    return F.count(value if kept is None else F.when(kept, value))


def count_by(
    facts: Facts,
    when: str,
    parts: Sequence[str],
    counted: str | None = None,
    name: str = "rentals",
) -> DataFrame:
    """Rows (or non-NULL ``counted`` values) per combination of calendar parts."""
    keys = [PARTS[part](F.col(when)).alias(part) for part in parts]
    return facts.groupBy(*keys).agg(number_of(facts, counted).alias(name))


def hour_cube(
    facts: DataFrame, when: str = "rental_date", counted: str = "rental_id"
) -> DataFrame:
    """Facts shrunk to one row per hour of the history: the hour in the place of
    the timestamp, ``row_count`` and ``id_count``.

    Written to a table once and read back as ``HourCube``, it serves every report on
    whole hours, so that many
    reports cost one scan of the facts instead of one each. ``date_hour_counts``
    with text bounds needs the facts, as its upper bound cuts into an hour.
    """
    hours = facts.groupBy(
        F.to_date(when).alias("rental_day"), F.hour(when).alias("hour")
    ).agg(F.count(F.lit(1)).alias("row_count"), F.count(counted).alias("id_count"))
    day = "year(rental_day), month(rental_day), day(rental_day)"
    return hours.selectExpr(
        f"make_timestamp_ntz({day}, hour, 0, 0) AS {when}", "row_count", "id_count"
    )


def daily_counts(facts: Facts, when: str = "rental_date") -> DataFrame:
    return count_by(facts, when, ["rental_day"]).orderBy("rental_day")


def hourly_counts(
    facts: Facts, when: str = "rental_date", counted: str | None = None
) -> DataFrame:
    return count_by(facts, when, ["hour"], counted).orderBy("hour")


def single_day_hours(
    facts: Facts,
    day: str,
    when: str = "rental_date",
    month_column: str | None = None,
) -> DataFrame:
    return hourly_counts(facts.where(within(when, day, month_column)), when)


def weekday_counts(facts: Facts, when: str = "rental_date") -> DataFrame:
    """Monday first; a missing timestamp comes first of all, with no name."""
    return (
        count_by(facts, when, ["weekday_no"])
        .orderBy("weekday_no")
        .select(weekday_name(F.col("weekday_no")).alias("weekday"), "rentals")
    )


def weekday_hour_counts(facts: Facts, when: str = "rental_date") -> DataFrame:
    """Largest first; equal counts by weekday name and hour."""
    return (
        count_by(facts, when, ["weekday_no", "hour"])
        .select(weekday_name(F.col("weekday_no")).alias("weekday"), "hour", "rentals")
        .orderBy(F.desc("rentals"), "weekday", "hour")
    )


def date_hour_counts(
    facts: Facts, when: str = "rental_date", counted: str = "rental_id"
) -> DataFrame:
    return (
        count_by(facts, when, ["rental_day", "hour"], counted)
        .withColumn("rental_day", date_text(F.col("rental_day"), "%Y-%m-%d"))
        .orderBy("rental_day", "hour")
    )


def slot_by_month(
    facts: Facts, day: int, hour: int, when: str = "rental_date"
) -> DataFrame:
    """One day-of-month and hour, counted in every month in which it occurs."""
    return (
        count_by(facts.where(in_slot(when, day, hour)), when, ["month"])
        .orderBy("month")
        .withColumn("month", month_text(F.col("month")))
    )
