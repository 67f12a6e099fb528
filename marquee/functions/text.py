"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The Korean words for year and month in labels.
YEAR_WORD, MONTH_WORD = "년", "월"


def month_label(month: Column) -> Column:
    """``2005년 7월`` from a DATE."""
    return F.date_format(month, f"yyyy{YEAR_WORD} M{MONTH_WORD}")


def month_label_from_text(text: Column) -> Column:
    """``2005년 7월`` from ``2005-07``."""
    number = F.substring(text, 6, 2).cast("int")
    return F.concat(
        F.substring(text, 1, 4), F.lit(f"{YEAR_WORD} "), number, F.lit(MONTH_WORD)
    )


def with_thousands(value: Column, unit: str = "") -> Column:
    """``12,345`` with the unit behind it."""
    return F.concat(F.format_number(value, 0), F.lit(unit))


def one_place(value: Column) -> Column:
    """One decimal without separators, ties to the even digit."""
    return F.format_string("%.1f", F.bround(value, 1))
