"""The store's reports by name, over tables with the store's own names.

``tables`` maps ``rental``, ``payment``, ``staff``, ``store``, ``customer``,
``inventory``, ``film``, ``film_category``, ``category`` and ``actor`` to frames
from any source; a report asks only for the tables it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from marquee.operators import (
    counts,
    matrices,
    overdue,
    peaks,
    periods,
    preferences,
    revenue,
    scans,
)
from marquee.session import shared_folder

Tables = Mapping[str, counts.Facts]


@dataclass(frozen=True)
class Choices:
    """What the reports look at closely, leave out and limit themselves to.

    An outlier is a day, a month or a year: ``2006-02-14``, ``2006-02``, ``2006``.
    """

    # What the store's own reports choose.
    single_day: str = "2006-02-14"
    slot_day: int = 14
    slot_hour: int = 15
    hour_outlier: str = "2006-02"
    weekday_outlier: str = "2006"
    first_day: str = "2005-01-01"
    last_day: str = "2007-12-31"
    top_share: float = 0.95
    revenue_period: str = "2005-07"
    # Partition column of ``rental``, if it has one: see ``operators/periods.py``.
    month_column: str | None = None


Report = Callable[[Tables, Choices], DataFrame]

STORE_QUERIES: dict[str, Report] = {}


def report(build: Report) -> Report:
    STORE_QUERIES[build.__name__] = build
    return build


def without_outlier(tables: Tables, choices: Choices) -> DataFrame:
    kept = periods.outside(
        "rental_date", choices.weekday_outlier, month_column=choices.month_column
    )
    return tables["rental"].where(kept)


# Volume and revenue


@report
def monthly_volume_revenue(tables: Tables, choices: Choices) -> DataFrame:
    return revenue.monthly_volume_revenue(tables["rental"], tables["payment"])


@report
def period_revenue(tables: Tables, choices: Choices) -> DataFrame:
    return revenue.period_revenue(
        tables["rental"],
        tables["payment"],
        choices.revenue_period,
        choices.month_column,
    )


@report
def store_month_operating_days(tables: Tables, choices: Choices) -> DataFrame:
    return revenue.store_month_operating_days(tables["staff"], tables["payment"])


@report
def store_month_revenue(tables: Tables, choices: Choices) -> DataFrame:
    return revenue.store_month_revenue(
        tables["store"], tables["staff"], tables["payment"]
    )


@report
def month_labels(tables: Tables, choices: Choices) -> DataFrame:
    return revenue.month_labels(tables["rental"])


# Counts per calendar part


@report
def daily_counts(tables: Tables, choices: Choices) -> DataFrame:
    return counts.daily_counts(tables["rental"])


@report
def hour_cube(tables: Tables, choices: Choices) -> DataFrame:
    return counts.hour_cube(tables["rental"])


@report
def hourly_counts(tables: Tables, choices: Choices) -> DataFrame:
    return counts.hourly_counts(tables["rental"], counted="rental_id")


@report
def single_day_hours(tables: Tables, choices: Choices) -> DataFrame:
    return counts.single_day_hours(
        tables["rental"], choices.single_day, month_column=choices.month_column
    )


@report
def spike_slot_by_month(tables: Tables, choices: Choices) -> DataFrame:
    return counts.slot_by_month(tables["rental"], choices.slot_day, choices.slot_hour)


@report
def weekday_counts(tables: Tables, choices: Choices) -> DataFrame:
    return counts.weekday_counts(tables["rental"])


@report
def weekday_hour_counts(tables: Tables, choices: Choices) -> DataFrame:
    return counts.weekday_hour_counts(tables["rental"])


@report
def weekday_hour_counts_excluding(tables: Tables, choices: Choices) -> DataFrame:
    return counts.weekday_hour_counts(without_outlier(tables, choices))


@report
def date_hour_counts(tables: Tables, choices: Choices) -> DataFrame:
    chosen = periods.between_texts(
        "rental_date", choices.first_day, choices.last_day, choices.month_column
    )
    return counts.date_hour_counts(tables["rental"].where(chosen))


# Matrices


@report
def heat_month_day(tables: Tables, choices: Choices) -> DataFrame:
    return matrices.month_by_day(tables["rental"])


@report
def heat_hour_day(tables: Tables, choices: Choices) -> DataFrame:
    return matrices.hour_by_day(tables["rental"])


@report
def heat_hour_day_excluding(tables: Tables, choices: Choices) -> DataFrame:
    kept = periods.outside(
        "rental_date", choices.hour_outlier, True, choices.month_column
    )
    return matrices.hour_by_day(tables["rental"].where(kept))


@report
def heat_weekday_hour(tables: Tables, choices: Choices) -> DataFrame:
    return matrices.weekday_by_hour(tables["rental"])


@report
def heat_weekday_hour_excluding(tables: Tables, choices: Choices) -> DataFrame:
    return matrices.weekday_by_hour(without_outlier(tables, choices))


@report
def heat_date_hour(tables: Tables, choices: Choices) -> DataFrame:
    return matrices.date_by_hour(tables["rental"])


# Peaks


@report
def hourly_peak(tables: Tables, choices: Choices) -> DataFrame:
    return peaks.hourly_peak(tables["rental"])


@report
def weekday_peak(tables: Tables, choices: Choices) -> DataFrame:
    return peaks.weekday_peak(tables["rental"])


@report
def top_slots(tables: Tables, choices: Choices) -> DataFrame:
    kept = periods.outside("rental_date", choices.weekday_outlier)
    return peaks.top_slots(tables["rental"], kept, choices.top_share)


@report
def top_slots_positional(tables: Tables, choices: Choices) -> DataFrame:
    kept = periods.outside("rental_date", choices.weekday_outlier)
    return peaks.top_slots_positional(tables["rental"], kept, choices.top_share)


@report
def slot_outliers(tables: Tables, choices: Choices) -> DataFrame:
    return peaks.slot_outliers(tables["rental"])


# Customers and items


@report
def top_category_per_customer(tables: Tables, choices: Choices) -> DataFrame:
    rented = preferences.rented_genres(
        tables["rental"],
        tables["inventory"],
        tables["film"],
        tables["film_category"],
        tables["category"],
    )
    return preferences.top_category_per_customer(tables["customer"], rented)


@report
def monthly_overdue_rate(tables: Tables, choices: Choices) -> DataFrame:
    rented = overdue.rented_durations(
        tables["rental"], tables["inventory"], tables["film"]
    )
    return overdue.monthly_overdue_rate(rented)


# Scans


@report
def rental_scan(tables: Tables, choices: Choices) -> DataFrame:
    return scans.whole_table(tables["rental"])


@report
def customer_scan(tables: Tables, choices: Choices) -> DataFrame:
    return scans.whole_table(tables["customer"])


@report
def actor_scan(tables: Tables, choices: Choices) -> DataFrame:
    return scans.whole_table(tables["actor"])


@report
def rental_return_dates(tables: Tables, choices: Choices) -> DataFrame:
    return scans.rental_return_dates(tables["rental"])


# Reports that an hour cube in the place of ``rental`` can answer.
FROM_CUBE = (
    "month_labels",
    "daily_counts",
    "hourly_counts",
    "single_day_hours",
    "spike_slot_by_month",
    "weekday_counts",
    "weekday_hour_counts",
    "weekday_hour_counts_excluding",
    "heat_month_day",
    "heat_hour_day",
    "heat_hour_day_excluding",
    "heat_weekday_hour",
    "heat_weekday_hour_excluding",
    "heat_date_hour",
    "hourly_peak",
    "weekday_peak",
    "top_slots",
    "top_slots_positional",
    "slot_outliers",
)


def calendar_reports(
    spark: SparkSession,
    rental: DataFrame,
    choices: Choices = Choices(),
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """All calendar reports from one scan of the rentals.

    The hour cube is written to ``folder``, by default below the shared folder,
    so a lost executor costs a re-read of it and not another scan.
    """
    folder = folder or shared_folder(spark, "hour-cube")
    counts.hour_cube(rental).write.parquet(folder)
    tables = {"rental": counts.HourCube(spark.read.parquet(folder))}
    on_cube = replace(choices, month_column=None)
    return {name: STORE_QUERIES[name](tables, on_cube) for name in FROM_CUBE}


def run_report(name: str, tables: Tables, choices: Choices = Choices()) -> DataFrame:
    return STORE_QUERIES[name](tables, choices)
