"""Peaks, quantile cut-offs and outlying hours.

Windows without partition keys occur here, and only over calendar slots that
are already counted: 24 hours, 7 weekdays or 168 weekday-hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marquee.functions import one_place, weekday_name, with_thousands
from marquee.operators.counts import Facts, count_by, number_of


def all_slots() -> WindowSpec:
    return Window.partitionBy()


def is_first(value: str, *ties: str) -> Column:
    """True on the row with the largest value, the first by ``ties`` if several."""
    place = F.row_number().over(Window.orderBy(F.desc(value), *ties))
    return place == 1


def hourly_peak(facts: Facts, when: str = "rental_date") -> DataFrame:
    """Counts per hour, their mean over the hours that occur, and the peak hour."""
    counts = count_by(facts, when, ["hour"])
    return (
        counts.withColumn("mean_rentals", F.avg("rentals").over(all_slots()))
        .withColumn("mean_label", one_place(F.col("mean_rentals")))
        .withColumn("is_peak", is_first("rentals", "hour"))
        .orderBy("hour")
    )


def weekday_peak(facts: Facts, when: str = "rental_date") -> DataFrame:
    """Counts per weekday with label, overall maximum and peak mark, Monday first."""
    counts = count_by(facts, when, ["weekday_no"])
    return (
        counts.withColumn("max_rentals", F.max("rentals").over(all_slots()))
        .withColumn("is_peak", is_first("rentals", "weekday_no"))
        .withColumn("rentals_label", with_thousands(F.col("rentals")))
        .orderBy("weekday_no")
        .select(
            weekday_name(F.col("weekday_no")).alias("weekday"),
            "rentals",
            "rentals_label",
            "max_rentals",
            "is_peak",
        )
    )


def slot_pairs(facts: Facts, kept: Column, when: str) -> DataFrame:
    """Weekday-hours counted over all rows and over the ``kept`` ones, in one scan."""
    slots = facts.groupBy(
        F.weekday(F.to_date(when)).alias("weekday_no"), F.hour(when).alias("hour")
    )
    return slots.agg(
        number_of(facts).alias("all_rows"),
        number_of(facts, kept=kept).alias("kept_rows"),
    ).withColumn("weekday", weekday_name(F.col("weekday_no")))


def with_cutoff(slots: DataFrame, value: str, share: float) -> DataFrame:
    """Exact quantile with linear interpolation, next to every slot."""
    cutoff = F.percentile(value, F.lit(share)).over(all_slots())
    return slots.withColumn("cutoff", cutoff)


def top_slots(
    facts: Facts, kept: Column, share: float = 0.95, when: str = "rental_date"
) -> DataFrame:
    """Slots of the kept rows that reach the quantile of the slots of all rows."""
    return (
        with_cutoff(slot_pairs(facts, kept, when), "all_rows", share)
        .where("kept_rows > 0 AND kept_rows >= cutoff")
        .selectExpr("weekday", "hour", "kept_rows AS rentals")
        .orderBy(F.desc("rentals"), "weekday", "hour")
    )


def top_slots_positional(
    facts: Facts, kept: Column, share: float = 0.95, when: str = "rental_date"
) -> DataFrame:
    """First K slots of all rows, K = number of kept slots that reach the quantile.

    This is what a mask over one descending list does to another one by row
    position. Lists of unequal length raise no error here.
    """
    slots = with_cutoff(slot_pairs(facts, kept, when), "all_rows", share)
    reached = F.count_if(F.expr("kept_rows > 0 AND kept_rows >= cutoff"))
    place = F.row_number().over(Window.orderBy(F.desc("all_rows"), "weekday", "hour"))
    return (
        slots.withColumn("reached", reached.over(all_slots()))
        .withColumn("place", place)
        .where("place <= reached")
        .selectExpr("weekday", "hour", "all_rows AS rentals")
        .orderBy(F.desc("rentals"), "weekday", "hour")
    )


def slot_outliers(
    facts: Facts,
    factor: float = 3.0,
    when: str = "rental_date",
    least_spread: float = 0.5,
) -> DataFrame:
    """Hours of a date far above the usual count of that hour of day (an addition).

    Far is more than ``factor`` median absolute deviations above the median of
    the dates on which the hour occurs; a deviation below ``least_spread`` counts as
    that, or one rental more would be far where all other dates are equal. The
    windows hold one row per date.
    """
    same_hour = Window.partitionBy("hour")
    half = F.lit(0.5)
    bar = F.greatest(F.col("spread"), F.lit(least_spread))
    return (
        count_by(facts.where(F.col(when).isNotNull()), when, ["rental_day", "hour"])
        .withColumn("usual", F.percentile("rentals", half).over(same_hour))
        .withColumn("distance", F.abs(F.col("rentals") - F.col("usual")))
        .withColumn("spread", F.percentile("distance", half).over(same_hour))
        .where(F.col("rentals") - F.col("usual") > factor * bar)
        .select("rental_day", "hour", "rentals", "usual", "spread")
        .orderBy(F.desc("rentals"), "rental_day", "hour")
    )
