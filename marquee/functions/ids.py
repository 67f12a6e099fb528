"""Sets of whole-number ids as bits.

Ids that lie close together, as numbers given out in turn do, share a word or a bitmap, so that
a set of them is shuffled or broadcast as a fraction of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

WORD_BITS = 6


def are_whole_numbers(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def bitmap_of(ids: Column) -> Column:
    """Which bitmap an id is in; each holds the bits of 32,768 ids."""
    return F.bitmap_bucket_number(ids.cast("bigint"))


def places_of(ids: Column) -> Column:
    """Aggregate: the places of the distinct ids in their bitmap, two bytes each; NULL ids
    have none. Where few of a bitmap's ids occur, that is far less than its 4 KB."""
    return F.collect_set(F.bitmap_bit_position(ids.cast("bigint")).cast("smallint"))


def word_of(ids: Column) -> Column:
    """Which 64-bit word an id is in."""
    return F.shiftright(ids.cast("bigint"), WORD_BITS)


def bit_in_word(ids: Column) -> Column:
    place = ids.cast("bigint").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def has_bit(word: Column, ids: Column) -> Column:
    return word.bitwiseAND(bit_in_word(ids)) != 0
