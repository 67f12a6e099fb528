"""Small rental-store frames, made by hand."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

RENTAL = (
    "rental_id BIGINT, rental_date TIMESTAMP_NTZ, return_date TIMESTAMP_NTZ, "
    "customer_id BIGINT, inventory_id BIGINT"
)
PAYMENT = (
    "payment_id BIGINT, rental_id BIGINT, staff_id BIGINT, amount DECIMAL(5,2), "
    "payment_date TIMESTAMP_NTZ"
)


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def rentals(spark, rows):
    """Rows of (rental_id, rental_date, return_date, customer_id, inventory_id)."""
    made = [(i, at(out), at(back), who, what) for i, out, back, who, what in rows]
    return spark.createDataFrame(made, RENTAL)


def dates_only(spark, *texts):
    return rentals(spark, [(i, text, None, 1, 1) for i, text in enumerate(texts)])


def payments(spark, rows):
    """Rows of (payment_id, rental_id, staff_id, amount text, payment_date)."""
    made = [(i, r, s, Decimal(a), at(when)) for i, r, s, a, when in rows]
    return spark.createDataFrame(made, PAYMENT)


def random_rentals(seed: int, size: int):
    """Rows with a spike in one slot, a month without rentals, and missing values."""
    pick = random.Random(seed)
    rows = []
    for number in range(size):
        out = datetime(2005, 5, 24) + timedelta(minutes=pick.randrange(60 * 24 * 90))
        if out.month == 7:
            out += timedelta(days=31)
        if number % 9 == 0:
            out = datetime(2006, 2, 14, 15, 16, 3)
        if number % 50 == 1:
            out = None
        back = None
        if out is not None and number % 11:
            back = out + timedelta(minutes=pick.randrange(60 * 24 * 9))
        rows.append((number, out, back, pick.randrange(12), pick.randrange(20)))
    return rows
