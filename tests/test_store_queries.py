"""All reports on a small store, in which the known findings are planted."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from handmade import RENTAL, payments

from marquee.plans import STORE_QUERIES, Choices, run_report


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    # Growth from May to July 2005, fewer in August, evenings only, then nothing.
    for month, per_day in ((5, 2), (6, 4), (7, 9), (8, 5)):
        for day in range(1, 29, 3):
            for i in range(per_day):
                out = datetime(2005, month, day, 18 + i % 4, i)
                back = out + timedelta(days=2 + i % 2 * 4)
                rows.append((len(rows), out, back, i % 5, 1 + i % 3))
    # The spike: 182 rentals in one hour, none of them returned.
    for i in range(182):
        out = datetime(2006, 2, 14, 15, 16, 3)
        rows.append((len(rows), out, None, i % 5, 1 + i % 3))
    rental = spark.createDataFrame(rows, RENTAL).cache()
    paid = [
        (i, i, 1 + i % 2, "2.99", (out + timedelta(hours=1)).isoformat())
        for i, out, *_ in rows
    ]
    ids = "store_id BIGINT"
    return {
        "rental": rental,
        "payment": payments(spark, paid),
        "staff": spark.createDataFrame([(1, 1), (2, 2)], "staff_id BIGINT, " + ids),
        "store": spark.createDataFrame([(1,), (2,)], ids),
        "customer": spark.createDataFrame(
            [(i, f"F{i}", f"L{i}") for i in range(5)],
            "customer_id BIGINT, first_name STRING, last_name STRING",
        ),
        "inventory": spark.createDataFrame(
            [(1, 1), (2, 2), (3, 2)], "inventory_id BIGINT, film_id BIGINT"
        ),
        "film": spark.createDataFrame(
            [(1, 3), (2, 4)], "film_id BIGINT, rental_duration INT"
        ),
        "film_category": spark.createDataFrame(
            [(1, 1), (2, 2)], "film_id BIGINT, category_id BIGINT"
        ),
        "actor": spark.createDataFrame([(1, "PENELOPE")], "actor_id INT, name STRING"),
        "category": spark.createDataFrame(
            [(1, "Action"), (2, "Drama")], "category_id BIGINT, name STRING"
        ),
    }


def rows(frame):
    return [tuple(row) for row in frame.collect()]


@pytest.mark.parametrize("name", sorted(STORE_QUERIES))
def test_every_report_runs(tables, name):
    frame = run_report(name, tables)
    assert len(set(frame.columns)) == len(frame.columns)
    # Hours of one or two rentals, as here, are nowhere far from usual.
    assert frame.count() > 0 or name == "slot_outliers"


def test_volume_rises_to_july_and_stops(tables):
    found = rows(run_report("monthly_volume_revenue", tables))
    assert [row[:2] for row in found] == [
        ("2005-05", 20),
        ("2005-06", 40),
        ("2005-07", 90),
        ("2005-08", 50),
        ("2006-02", 182),
    ]
    assert all(float(revenue) == round(n * 2.99, 2) for _, n, revenue in found)


def test_the_spike_is_one_hour_of_one_day(tables):
    assert rows(run_report("single_day_hours", tables)) == [(15, 182)]
    assert rows(run_report("spike_slot_by_month", tables)) == [("2006-02", 182)]
    peak = [row for row in rows(run_report("hourly_peak", tables)) if row[-1]]
    assert [row[:2] for row in peak] == [(15, 182)]


def test_matrices_without_the_spike(tables):
    whole = rows(run_report("heat_hour_day", tables))
    rest = rows(run_report("heat_hour_day_excluding", tables))
    assert whole[15][14] == 182 and rest[15][14] == 0
    assert sum(map(sum, (row[1:] for row in whole))) == 382
    assert sum(map(sum, (row[1:] for row in rest))) == 200
    weekdays = rows(run_report("heat_weekday_hour_excluding", tables))
    assert sum(sum(row[1:]) for row in weekdays) == 200


def test_less_than_half_of_the_days_are_operating_days(tables):
    for row in rows(run_report("store_month_operating_days", tables)):
        assert 1 <= row[4] <= 10


def test_overdue_rate_counts_returned_rentals_only(tables):
    found = rows(run_report("monthly_overdue_rate", tables))
    assert [row[:2] for row in found][-1] == ("2005-08", 50)
    for _, total, late, percent in found:
        assert 0 <= late <= total
        assert percent == late * 100.0 / total


def test_own_choices(tables):
    choices = Choices(
        single_day="2005-07-01", first_day="2005-07-01", last_day="2005-07-02"
    )
    assert sum(n for _, n in rows(run_report("single_day_hours", tables, choices))) == 9
    found = rows(run_report("date_hour_counts", tables, choices))
    assert {day for day, *_ in found} == {"2005-07-01"}
