"""Exact quantiles of counts over any number of groups.

A few hundred counted slots fit one window; counts per customer, weekday and hour do not. The
value of a rank is found by counting instead: rows per range of values, then per range of
the one that holds the rank, until a range is one value. Every pass is one aggregation whose
result is a row per range.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import weekday_name
from marquee.operators.counts import number_of
from marquee.session import written

RANGES = 1024


def value_of_rank(values: DataFrame, column: str, rank: int, low: int, high: int) -> tuple[int, int]:
    """The value at a place of the ascending order (from 0) between two bounds, and the
    number of values up to it."""
    below = 0
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        place = F.floor((F.col(column) - F.lit(low)) / F.lit(width))
        inside = values.where(F.col(column).between(low, high))
        counts = inside.groupBy(place.alias("place")).count().collect()
        for found, number in sorted(counts):
            if below + number > rank:
                low, high = low + found * width, min(high, low + (found + 1) * width - 1)
                break
            below += number
    return low, below + values.where(F.col(column) == low).count()


def exact_quantile(values: DataFrame, column: str, share: float) -> float | None:
    """Quantile of a whole-number column with linear interpolation; NULLs do not count,
    and without a value there is none. Equal to ``percentile``, without a task that
    holds the values or a row per value."""
    known = values.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("value"))
    number, low, high = known.agg(F.count("value"), F.min("value"), F.max("value")).first()
    if not number:
        return None
    position = (number - 1) * share
    first, upto = value_of_rank(known, "value", floor(position), low, high)
    if ceil(position) < upto or first == high:
        return float(first)
    (second,) = known.where(F.col("value") > first).agg(F.min("value")).first()
    return (ceil(position) - position) * first + (position - floor(position)) * second


def top_groups(
    facts: DataFrame, keys: dict[str, Column], kept: Column, share: float = 0.95
) -> DataFrame:
    """Groups of the kept rows that reach the quantile of the groups of all rows.

    As ``top_slots``, for any keys and any number of groups. The counted groups are
    written once, as several passes read them.
    """
    counted = facts.groupBy(*[column.alias(name) for name, column in keys.items()]).agg(
        number_of(facts).alias("all_rows"), number_of(facts, kept=kept).alias("kept_rows")
    )
    counted = written(counted, "groups")
    cutoff = exact_quantile(counted, "all_rows", share)
    reached = (F.col("kept_rows") > 0) & (F.col("kept_rows") >= F.lit(cutoff))
    return counted.where(reached).select(*keys, F.col("kept_rows").alias("rentals"))


def top_customer_slots(
    facts: DataFrame, kept: Column, share: float = 0.95, when: str = "rental_date"
) -> DataFrame:
    """The busiest weekday-hours of single customers, largest first."""
    keys = {
        "customer_id": F.col("customer_id"),
        "weekday_no": F.weekday(F.to_date(when)),
        "hour": F.hour(when),
    }
    found = top_groups(facts, keys, kept, share)
    named = found.withColumn("weekday", weekday_name(F.col("weekday_no")))
    return named.orderBy(F.desc("rentals"), "customer_id", "weekday", "hour").select(
        "customer_id", "weekday", "hour", "rentals"
    )
