"""Revenue and volume over payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import (
    Money,
    are_whole_numbers,
    bit_in_word,
    bitmap_of,
    days_in_month,
    has_bit,
    month_label,
    month_label_from_text,
    month_start,
    month_text,
    places_of,
    two_places,
    with_thousands,
    word_of,
)
from marquee.operators.counts import count_by
from marquee.operators.periods import within
from marquee.session import written

# Words of 64 ids that are sent to all tasks at most: 16 bytes each.
MOST_WORDS = 1 << 21


def monthly_volume_revenue(rental: DataFrame, payment: DataFrame) -> DataFrame:
    """Rental-payment pairs and revenue per month of the rental.

    Payments are first summed per rental, on the join key: the join then reuses
    that shuffle, and a rental with very many payments reaches it as one row per
    map task. Rentals are counted per id and month before the join, so an id that
    repeats any number of times is few rows too.
    """
    money = Money.of(payment, "amount")
    paid = (
        payment.where("rental_id IS NOT NULL")
        .groupBy("rental_id")
        .agg(F.count(F.lit(1)).alias("payments"), F.sum(money.summand()).alias("total"))
    )
    dated = (
        rental.where("rental_id IS NOT NULL")
        .select("rental_id", month_start(F.col("rental_date")).alias("month"))
        .groupBy("rental_id", "month")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    copies = F.col("copies")
    return (
        dated.join(paid, "rental_id")
        .groupBy("month")
        .agg(
            F.sum(F.col("payments") * copies).alias("rentals"),
            F.sum(money.times(F.col("total"), copies)).alias("total"),
        )
        .orderBy("month")
        .select(
            month_text(F.col("month")).alias("month"),
            "rentals",
            money.rounded(F.col("total")).alias("revenue"),
        )
    )


def payments_of(payment: DataFrame, ids: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The payments whose ``rental_id`` is among ``ids``, not yet shuffled where that set is
    small enough to go to all tasks; otherwise all payments, for a join to sort out.

    The set is a table of 64-bit words, whose number is counted before it is sent.
    """
    if not all(are_whole_numbers(f.schema["rental_id"].dataType) for f in (payment, ids)):
        return payment
    id_ = F.col("rental_id")
    words = ids.where("rental_id IS NOT NULL").groupBy(word_of(id_).alias("word"))
    words = written(words.agg(F.bit_or(bit_in_word(id_)).alias("bits")), "rental-words")
    if words.count() > most_words:
        return payment
    kept = payment.join(F.broadcast(words), word_of(id_) == F.col("word"))
    return kept.where(has_bit(F.col("bits"), id_)).drop("word", "bits")


def period_revenue(
    rental: DataFrame,
    payment: DataFrame,
    period: str,
    month_column: str | None = None,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``monthly_volume_revenue`` of a year, month or day of rentals.

    The period prunes the rentals' scan, and their ids the payments before the shuffle.
    """
    chosen = rental.where(within("rental_date", period, month_column))
    paid = payments_of(payment, chosen.select("rental_id"), most_words)
    return monthly_volume_revenue(chosen, paid)


def store_payments(staff: DataFrame, payment: DataFrame) -> DataFrame:
    """Payments with the store of the staff member who took them."""
    return payment.join(staff.select("staff_id", "store_id"), "staff_id")


def store_month_revenue(
    store: DataFrame, staff: DataFrame, payment: DataFrame
) -> DataFrame:
    """Revenue and number of payments per store and month of payment.

    The store table only confirms that a store exists, so it meets one row per
    store and month instead of the payments.
    """
    money = Money.of(payment, "amount")
    totals = (
        store_payments(staff, payment)
        .groupBy("store_id", month_start(F.col("payment_date")).alias("month"))
        .agg(
            F.sum(money.summand()).alias("total"),
            F.count("payment_id").alias("payments"),
        )
    )
    return (
        totals.join(store.select("store_id"), "store_id")
        .orderBy("store_id", "month")
        .select(
            "store_id",
            month_text(F.col("month")).alias("month"),
            money.rounded(F.col("total")).alias("revenue"),
            "payments",
        )
    )


def store_month_operating_days(
    staff: DataFrame, payment: DataFrame, bitmaps: bool = True
) -> DataFrame:
    """Per store and month: revenue, distinct rentals, days with a payment, and
    revenue per calendar day of the month.

    The days are a 31-bit set. The rentals are places in ranges of 32,768 ids: what is
    shuffled is a row per task, store, month and range with two bytes per rental, in place
    of a row per rental. Without ``bitmaps``, and for ids that are no whole numbers, it is
    one row per store, month and rental, which suits payments that are stored in buckets
    of their rental.
    """
    money = Money.of(payment, "amount")
    by_bits = bitmaps and are_whole_numbers(payment.schema["rental_id"].dataType)
    paid = store_payments(staff, payment).select(
        "store_id",
        month_start(F.col("payment_date")).alias("month"),
        F.expr("shiftleft(1, dayofmonth(payment_date) - 1)").alias("day_bit"),
        "rental_id",
        "amount",
    )
    # Amounts become summands as they are summed: what is sorted by store stays narrow.
    total, rentals = F.sum(money.summand()), F.count_distinct("rental_id")
    if by_bits:
        bitmap = bitmap_of(F.col("rental_id")).alias("bitmap")
        paid = paid.groupBy("store_id", "month", bitmap).agg(
            total.alias("amount"),
            F.bit_or("day_bit").alias("day_bit"),
            F.size(places_of(F.col("rental_id"))).alias("rentals"),
        )
        total, rentals = F.sum("amount"), F.sum("rentals")
    totals = paid.groupBy("store_id", "month").agg(
        total.alias("total"),
        rentals.alias("rentals"),
        F.coalesce(F.bit_count(F.bit_or("day_bit")), F.lit(0)).alias("operating_days"),
    )
    # Divided before anything is rounded, with two places more than a cent needs.
    per_day = money.exact(F.col("total")) / days_in_month(F.col("month"))
    return totals.orderBy("store_id", "month").select(
        "store_id",
        month_text(F.col("month")).alias("month"),
        money.rounded(F.col("total")).alias("revenue"),
        "rentals",
        "operating_days",
        two_places(per_day).alias("revenue_per_day"),
    )


# Fixed value: the counter word of the labels.
COUNTER = "건"


def month_labels(facts: DataFrame, when: str = "rental_date") -> DataFrame:
    """Months with their count, as display labels."""
    months = count_by(facts, when, ["month"]).orderBy("month")
    text = month_text(F.col("month"))
    return months.select(
        text.alias("month"),
        month_label(F.col("month")).alias("label"),
        month_label_from_text(text).alias("label_from_text"),
        "rentals",
        with_thousands(F.col("rentals"), COUNTER).alias("rentals_label"),
    )
