"""Money, rates and day differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


@dataclass(frozen=True)
class Money:
    """An amount to be summed exactly, in any order, and rounded after the sum.

    Columns typed DECIMAL with two places at most are summed as BIGINT cents, which
    is narrower and faster; they reach to 92 quadrillion. All others are summed as
    DECIMAL with six places, to which a DOUBLE is rounded once. Beyond its range a
    sum is an error in ANSI mode, and NULL (DECIMAL) or wrong (BIGINT) without it.
    """

    column: str
    in_cents: bool

    @classmethod
    def of(cls, frame: DataFrame, column: str) -> Money:
        kind = frame.schema[column].dataType
        return cls(column, isinstance(kind, DecimalType) and kind.scale <= 2)

    def summand(self) -> Column:
        amount = F.col(self.column)
        if self.in_cents:
            return (amount * 100).cast("bigint")
        return amount.cast("decimal(24,6)")

    def times(self, total: Column, copies: Column) -> Column:
        """A sum taken several times."""
        product = total * copies
        return product if self.in_cents else product.cast("decimal(38,6)")

    def exact(self, total: Column) -> Column:
        """A sum of ``summand`` as DECIMAL."""
        if self.in_cents:
            return (total.cast("decimal(20,0)") / 100).cast("decimal(20,2)")
        return total

    def rounded(self, total: Column) -> Column:
        """The same with two places, halves away from zero."""
        return F.round(self.exact(total), 2).cast("decimal(20,2)")


def two_places(amount: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(amount, 2)


def percentage(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; NULL for an empty whole."""
    return F.try_divide(part * F.lit(100.0), whole)


def days_between(later: Column, earlier: Column) -> Column:
    """Calendar days, so 23:59 to 00:01 of the next day is one day."""
    return F.datediff(F.to_date(later), F.to_date(earlier))
