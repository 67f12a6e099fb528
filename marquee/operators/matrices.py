"""Dense calendar matrices: one row per slot, one column per slot, zeros filled in.

The pivot has its column values given, so Spark needs no extra job to find them
and aggregates to (row, column) pairs before it spreads them over columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import PARTS, date_text, month_label, weekday_name
from marquee.operators.counts import Facts, number_of

DAYS = range(1, 32)
HOURS = range(24)


def spread(
    facts: Facts, row: Column, column: Column, values: range, measure: Column
) -> DataFrame:
    """``row_key`` and one column per value, NULL where nothing was found.

    Rows without a key must be filtered out before.
    """
    keyed = facts.withColumns({"row_key": row, "column_key": column})
    return keyed.groupBy("row_key").pivot("column_key", list(values)).agg(measure)


def by_parts(
    facts: Facts,
    when: str,
    row: str,
    column: str,
    values: range,
    counted: str | None = None,
) -> DataFrame:
    """Two calendar parts of one timestamp against each other."""
    stamp = F.col(when)
    known = facts.where(stamp.isNotNull())
    measure = number_of(facts, counted)
    return spread(known, PARTS[row](stamp), PARTS[column](stamp), values, measure)


def cells(values: range, prefix: str) -> list[str]:
    """Named matrix columns with zeros for NULL."""
    return [f"coalesce(`{value}`, 0L) AS {prefix}{value}" for value in values]


def every_row(spark: SparkSession, matrix: DataFrame, rows: range) -> DataFrame:
    """Adds the rows of ``rows`` the matrix lacks, in order.

    The matrix has at most ``len(rows)`` rows (24 hours or 7 weekdays), which is
    what bounds the broadcast.
    """
    spine = spark.range(rows.start, rows.stop, 1, numPartitions=1)
    spine = spine.selectExpr("CAST(id AS INT) AS row_key")
    return spine.join(F.broadcast(matrix), "row_key", "left").orderBy("row_key")


def month_by_day(facts: Facts, when: str = "rental_date") -> DataFrame:
    """Months in time order × days 1 to 31; a month without rows has no row."""
    matrix = by_parts(facts, when, "month", "day", DAYS)
    labelled = matrix.withColumn("month_label", month_label(F.col("row_key")))
    return labelled.orderBy("row_key").selectExpr("month_label", *cells(DAYS, "d"))


def hour_by_day(
    facts: Facts, when: str = "rental_date", counted: str = "rental_id"
) -> DataFrame:
    """Hours 0 to 23 × days 1 to 31, all months together."""
    matrix = by_parts(facts, when, "hour", "day", DAYS, counted)
    dense = every_row(facts.sparkSession, matrix, HOURS)
    return dense.selectExpr("row_key AS hour", *cells(DAYS, "d"))


def weekday_by_hour(facts: Facts, when: str = "rental_date") -> DataFrame:
    """Monday to Sunday × hours 0 to 23."""
    matrix = by_parts(facts, when, "weekday_no", "hour", HOURS)
    dense = every_row(facts.sparkSession, matrix, range(7))
    labelled = dense.withColumn("weekday", weekday_name(F.col("row_key")))
    return labelled.selectExpr("weekday", *cells(HOURS, "h"))


def date_by_hour(facts: Facts, when: str = "rental_date") -> DataFrame:
    """Dates that occur × hours 0 to 23."""
    matrix = by_parts(facts, when, "rental_day", "hour", HOURS)
    dated = matrix.withColumn("rental_day", date_text(F.col("row_key"), "%Y-%m-%d"))
    return dated.orderBy("row_key").selectExpr("rental_day", *cells(HOURS, "h"))


def counted_dates_by_hour(counts: DataFrame) -> DataFrame:
    """The same from rows already counted per (rental_day text, hour)."""
    known = counts.where("rental_day IS NOT NULL AND hour IS NOT NULL")
    matrix = spread(known, F.col("rental_day"), F.col("hour"), HOURS, F.sum("rentals"))
    return matrix.orderBy("row_key").selectExpr(
        "row_key AS rental_day", *cells(HOURS, "h")
    )
