"""Whole tables and column projections."""

from __future__ import annotations

from pyspark.sql import DataFrame


def whole_table(table: DataFrame) -> DataFrame:
    return table.select("*")


def rental_return_dates(rental: DataFrame) -> DataFrame:
    return rental.select("rental_date", "return_date")
