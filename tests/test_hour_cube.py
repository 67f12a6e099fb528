"""Reports from the hour cube equal the reports from the rentals."""

from __future__ import annotations

import pytest
from handmade import RENTAL, random_rentals

from marquee.operators import counts
from marquee.plans import calendar_reports, run_report
from marquee.plans.store_queries import FROM_CUBE


@pytest.fixture(scope="module")
def rental(spark):
    rows = random_rentals(seed=9, size=700)
    rows += [(None, *rows[2][1:]), (None, None, None, 1, 1)]
    return spark.createDataFrame(rows, RENTAL).cache()


@pytest.fixture(scope="module")
def reports(spark, rental):
    return calendar_reports(spark, rental)


@pytest.mark.parametrize("name", FROM_CUBE)
def test_same_report(rental, reports, name):
    expected = run_report(name, {"rental": rental})
    assert reports[name].dtypes == expected.dtypes
    assert reports[name].collect() == expected.collect()


def test_a_column_named_like_the_cubes(spark):
    """Facts are counted as facts, whatever their columns are called."""
    facts = spark.range(3).selectExpr(
        "id AS rental_id",
        "TIMESTAMP_NTZ '2005-05-24 10:00:00' AS rental_date",
        "7 AS row_count",
        "9 AS id_count",
    )
    assert [tuple(row) for row in counts.hourly_counts(facts).collect()] == [(10, 3)]
    assert counts.weekday_counts(facts).first().rentals == 3


def test_a_cube_counts_one_column(rental):
    cube = counts.HourCube(counts.hour_cube(rental))
    with pytest.raises(ValueError):
        counts.hourly_counts(cube, counted="customer_id")


def test_one_row_per_hour(rental):
    cube = counts.hour_cube(rental)
    assert cube.select("rental_date").distinct().count() == cube.count()
    assert cube.groupBy().sum("row_count", "id_count").first()[:] == (702, 700)
