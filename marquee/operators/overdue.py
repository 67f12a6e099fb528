"""Late returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import days_between, month_start, month_text, percentage
from marquee.session import written


def rented_durations(
    rental: DataFrame, inventory: DataFrame, film: DataFrame
) -> DataFrame:
    """Rentals with the allowed days of their film.

    The items are joined with their films first and written, so that their size is
    known and the rentals meet one plain table, by item.
    """
    films = film.select("film_id", "rental_duration")
    items = inventory.select("inventory_id", "film_id").join(films, "film_id")
    return rental.join(written(items, "item-durations"), "inventory_id")


def monthly_overdue_rate(rented: DataFrame) -> DataFrame:
    """Returned rentals per month of rental, how many came back late, and the rate.

    Late means more calendar days than allowed. ``rented`` has ``rental_id``,
    ``rental_date``, ``return_date`` and ``rental_duration``.
    """
    days_out = days_between(F.col("return_date"), F.col("rental_date"))
    late = days_out > F.col("rental_duration")
    return (
        rented.where("return_date IS NOT NULL")
        .groupBy(month_start(F.col("rental_date")).alias("month"))
        .agg(
            F.count("rental_id").alias("rentals"),
            F.sum(F.when(late, 1).otherwise(0)).alias("overdue"),
        )
        .orderBy("month")
        .select(
            month_text(F.col("month")).alias("month"),
            "rentals",
            "overdue",
            percentage(F.col("overdue"), F.col("rentals")).alias("overdue_percent"),
        )
    )
