from __future__ import annotations

from collections import defaultdict
from datetime import datetime
from decimal import Decimal

import pytest
from handmade import payments, rentals
from pyspark.sql import functions as F

from marquee.operators import overdue, revenue
from marquee.operators.revenue import (
    monthly_volume_revenue,
    period_revenue,
    store_month_operating_days,
)


def rows(frame):
    return [tuple(row) for row in frame.collect()]


@pytest.fixture(scope="module")
def rental(spark):
    return rentals(
        spark,
        [
            (1, "2005-05-24T22:53", "2005-05-26T22:04", 1, 1),
            (2, "2005-05-31T23:59", "2005-06-01T00:01", 1, 1),
            (3, "2005-07-01T00:00", None, 2, 2),
            (4, None, None, 2, 2),
        ],
    )


@pytest.fixture(scope="module")
def payment(spark):
    return payments(
        spark,
        [
            (1, 1, 1, "2.99", "2005-05-25T11:30"),
            (2, 1, 1, "0.99", "2005-05-25T12:30"),
            (3, 2, 2, "4.99", "2005-06-15T22:53"),
            (4, None, 2, "1.99", "2005-06-16T08:00"),
            (5, 77, 3, "9.99", "2005-06-16T09:00"),
            (6, 4, 1, "5.00", "2005-05-31T09:00"),
        ],
    )


@pytest.fixture(scope="module")
def staff(spark):
    rows = [(1, 10), (2, 20), (3, 10), (4, 30)]
    return spark.createDataFrame(rows, "staff_id BIGINT, store_id BIGINT")


def test_months_count_joined_rows(rental, payment):
    found = rows(revenue.monthly_volume_revenue(rental, payment))
    assert found == [
        (None, 1, Decimal("5.00")),
        ("2005-05", 3, Decimal("8.97")),
    ]


def test_one_rental_with_very_many_payments(spark):
    rental = rentals(
        spark, [(i, "2005-05-24T22:53", None, 1, 1) for i in range(50)]
    )
    many = spark.range(30_000).selectExpr(
        "id AS payment_id",
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 60 END AS rental_id",
        "1 AS staff_id",
        "CAST(id % 500 AS DECIMAL(10,2)) / 100 AS amount",
        "TIMESTAMP_NTZ '2005-05-25 10:00:00' AS payment_date",
    )
    paid = [(7 if i % 3 == 0 else i % 60, i % 500) for i in range(30_000)]
    known = [cents for key, cents in paid if key < 50]
    expected = ("2005-05", len(known), Decimal(sum(known)) / 100)
    assert rows(revenue.monthly_volume_revenue(rental, many)) == [expected]


def test_copies_of_a_rental(spark, payment):
    copies = [(1, "2005-05-24T22:53", None, 1, 1)] * 1000
    copies += [(1, "2005-06-24T22:53", None, 1, 1)] * 3 + [(2, None, None, 1, 1)]
    frame = revenue.monthly_volume_revenue(rentals(spark, copies), payment)
    assert rows(frame) == [
        (None, 1, Decimal("4.99")),
        ("2005-05", 2000, Decimal("3980.00")),
        ("2005-06", 6, Decimal("11.94")),
    ]


def test_store_months(spark, staff, payment):
    store = spark.createDataFrame([(10,), (20,)], "store_id BIGINT")
    assert rows(revenue.store_month_revenue(store, staff, payment)) == [
        (10, "2005-05", Decimal("8.98"), 3),
        (10, "2005-06", Decimal("9.99"), 1),
        (20, "2005-06", Decimal("6.98"), 2),
    ]
    only = spark.createDataFrame([(20,)], "store_id BIGINT")
    found = rows(revenue.store_month_revenue(only, staff, payment))
    assert [row[0] for row in found] == [20]


def test_operating_days_and_calendar_days(staff, payment):
    assert rows(revenue.store_month_operating_days(staff, payment)) == [
        # 8.98 / 31, 9.99 / 30, 6.98 / 30; a missing rental is no rental
        (10, "2005-05", Decimal("8.98"), 2, 2, Decimal("0.29")),
        (10, "2005-06", Decimal("9.99"), 1, 1, Decimal("0.33")),
        (20, "2005-06", Decimal("6.98"), 1, 2, Decimal("0.23")),
    ]


def test_operating_days_against_plain_sets(spark, staff):
    many = spark.range(20_000).selectExpr(
        "id AS payment_id",
        "(id * 7919) % 4000 AS rental_id",
        "1 + id % 4 AS staff_id",
        "CAST((id * 31) % 1200 AS DECIMAL(10,2)) / 100 AS amount",
        "TIMESTAMP_NTZ '2004-01-31 23:59:59'"
        " + make_dt_interval(CAST(id * 17 % 400 AS INT)) AS payment_date",
    )
    by_store = {1: 10, 2: 20, 3: 10, 4: 30}
    groups = defaultdict(list)
    for row in many.collect():
        key = (by_store[row.staff_id], row.payment_date.strftime("%Y-%m"))
        groups[key].append(row)
    found = rows(revenue.store_month_operating_days(staff, many))
    assert [row[:2] for row in found] == sorted(groups)
    for store, month, total, rented, days, _ in found:
        group = groups[store, month]
        assert total == sum(row.amount for row in group)
        assert rented == len({row.rental_id for row in group})
        assert days == len({row.payment_date.date() for row in group})


@pytest.mark.parametrize(
    "month, amount, expected",
    [
        # Quotients that end in a half cent, for 28, 29, 30 and 31 days.
        ("2005-02", "0.14", "0.01"),
        ("2004-02", "2.90", "0.10"),
        ("2005-04", "0.45", "0.02"),
        ("2005-07", "0.62", "0.02"),
        ("2005-04", "0.15", "0.01"),
    ],
)
def test_half_cents_per_day(spark, staff, month, amount, expected):
    frame = payments(spark, [(1, 1, 1, amount, f"{month}-03T10:00")])
    found = rows(revenue.store_month_operating_days(staff, frame))
    assert found[0][-1] == Decimal(expected)


@pytest.mark.parametrize("kind", ["DOUBLE", "DECIMAL(10,4)"])
def test_parts_of_cents_add_up(spark, staff, kind):
    """Amounts below a cent count in every revenue report."""
    rental = rentals(spark, [(i, "2005-05-24T22:53", None, 1, 1) for i in range(1000)])
    store = spark.createDataFrame([(10,)], "store_id BIGINT")
    paid = spark.range(1000).selectExpr(
        "id AS payment_id",
        "id AS rental_id",
        "CAST(1 AS BIGINT) AS staff_id",
        f"CAST(0.004 AS {kind}) AS amount",
        "TIMESTAMP_NTZ '2005-05-25 10:00:00' AS payment_date",
    )
    total = Decimal("4.00")
    assert rows(revenue.monthly_volume_revenue(rental, paid)) == [("2005-05", 1000, total)]
    assert rows(revenue.store_month_revenue(store, staff, paid)) == [
        (10, "2005-05", total, 1000)
    ]
    assert rows(revenue.store_month_operating_days(staff, paid)) == [
        (10, "2005-05", total, 1000, 1, Decimal("0.13"))
    ]


def test_month_labels(rental):
    assert rows(revenue.month_labels(rental.where("rental_date IS NOT NULL"))) == [
        ("2005-05", "2005년 5월", "2005년 5월", 2, "2건"),
        ("2005-07", "2005년 7월", "2005년 7월", 1, "1건"),
    ]


def test_overdue_by_calendar_days(spark):
    rental = rentals(
        spark,
        [
            (1, "2005-05-24T23:59", "2005-05-27T00:01", 1, 1),  # 3 of 3 days
            (2, "2005-05-24T23:59", "2005-05-28T00:01", 1, 1),  # 4 of 3 days
            (3, "2005-05-24T12:00", None, 1, 1),  # not returned
            (4, "2005-06-30T12:00", "2005-07-05T08:00", 1, 2),  # 5 of 5 days
            (5, "2005-06-30T12:00", "2005-07-05T08:00", 1, 9),  # unknown item
            (6, None, "2005-07-05T08:00", 1, 1),  # no rental date: never late
        ],
    )
    inventory = spark.createDataFrame(
        [(1, 100), (2, 200)], "inventory_id BIGINT, film_id BIGINT"
    )
    film = spark.createDataFrame(
        [(100, 3), (200, 5)], "film_id BIGINT, rental_duration INT"
    )
    rented = overdue.rented_durations(rental, inventory, film)
    assert rows(overdue.monthly_overdue_rate(rented)) == [
        (None, 1, 0, 0.0),
        ("2005-05", 2, 1, 50.0),
        ("2005-06", 1, 0, 0.0),
    ]


def shuffled_rows(frame, metric="shuffleRecordsWritten"):
    """Rows written by the exchanges of a frame that has run, from Spark's metrics."""
    frame.collect()
    total = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Exchange"):
            total.append(node.metrics().apply(metric).value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return total


@pytest.fixture(scope="module")
def many_payments(spark):
    """Two stores, two months, 40,000 rentals with two payments each, some of them negative ids."""
    return spark.range(80_000).selectExpr(
        "id AS payment_id",
        "CASE WHEN id % 1000 = 0 THEN NULL ELSE CAST(id / 2 AS BIGINT) - 5000 END AS rental_id",
        "id % 2 + 1 AS staff_id",
        "CAST(id % 7 AS DECIMAL(5,2)) AS amount",
        "make_timestamp_ntz(2005, 7 + CAST(id % 3 = 0 AS INT), CAST(1 + id % 28 AS INT), 1, 1, 1) AS payment_date",
    )


def test_rentals_as_bitmaps(spark, staff, many_payments):
    by_bits = store_month_operating_days(staff, many_payments)
    by_ids = store_month_operating_days(staff, many_payments, bitmaps=False)
    as_text = store_month_operating_days(
        staff, many_payments.withColumn("rental_id", F.col("rental_id").cast("string"))
    )
    assert rows(by_bits) == rows(by_ids) == rows(as_text) and len(rows(by_bits)) == 4
    assert sum(r.rentals for r in by_bits.collect()) > 40_000
    # At most a row per task (8), store, month and bitmap (3 of the ids, 1 without).
    assert max(shuffled_rows(by_bits)) <= 8 * 2 * 2 * 4 < 1000 < 40_000 <= max(shuffled_rows(by_ids))


def test_far_apart_rentals_are_narrow_rows(spark, staff):
    """Ids that share no bitmap: what a reduce task sorts is not 4 KB for each."""
    far = spark.range(0, 3000, 1, 8).selectExpr(
        "id AS payment_id",
        "id * 40000 AS rental_id",
        "1 AS staff_id",
        "CAST(1 AS DECIMAL(5,2)) AS amount",
        "TIMESTAMP_NTZ '2005-07-01 00:00:00' AS payment_date",
    )
    frame = store_month_operating_days(staff, far)
    assert max(shuffled_rows(frame, "dataSize")) < 3000 * 200
    assert [r.rentals for r in frame.collect()] == [3000]


def test_no_payment_with_a_rental(spark, staff):
    rows_ = payments(spark, [(1, None, 1, "2.00", "2005-07-01"), (2, None, 1, "3.00", "2005-07-01")])
    (row,) = store_month_operating_days(staff, rows_).collect()
    assert (row.rentals, row.operating_days) == (0, 1)


@pytest.mark.parametrize("most_words", [1 << 21, 0])
def test_revenue_of_a_period(spark, many_payments, most_words):
    """Equal to the rows of the whole report, with the set of ids sent out or too large for it."""
    rental = spark.range(-5000, 40_000).selectExpr(
        "id AS rental_id",
        "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ '2005-07-01') AS rental_date",
    )
    whole = {r.month: r for r in monthly_volume_revenue(rental, many_payments).collect()}
    for period, months in (("2005-07", ["2005-07"]), ("2006", [f"2006-{m:02}" for m in range(1, 13)]), ("1999", [])):
        found = period_revenue(rental, many_payments, period, most_words=most_words)
        assert found.collect() == [whole[m] for m in months]
    one = period_revenue(rental, many_payments, "2005-07-02", most_words=most_words)
    assert [r.rentals for r in one.collect()] == [48]


def test_a_period_shuffles_its_payments_only(spark, many_payments):
    rental = spark.range(40_000).selectExpr(
        "id AS rental_id",
        "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ '2005-07-01') AS rental_date",
    )
    # A month has 744 hours, so as many rentals.
    found = shuffled_rows(period_revenue(rental, many_payments, "2005-07"))
    assert max(found) <= 8 * 744
    assert max(shuffled_rows(monthly_volume_revenue(rental, many_payments))) >= 35_000


def test_ids_of_other_types_in_a_period(spark, many_payments):
    text = F.col("rental_id").cast("string").alias("rental_id")
    rental = spark.range(100).select(
        F.col("id").alias("rental_id"), F.lit(datetime(2005, 7, 4)).cast("timestamp_ntz").alias("rental_date")
    )
    named = rental.withColumn("rental_id", text)
    paid = many_payments.withColumn("rental_id", text)
    assert period_revenue(named, paid, "2005").collect() == period_revenue(rental, many_payments, "2005").collect()
