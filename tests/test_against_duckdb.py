"""Every registered query against its SQL in DuckDB, whole tables, exact values."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from marquee.plans import ORACLES, QUERIES, run_report
from marquee.sources import standins

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'"
        )
    yield connection
    connection.close()


def by_column_name(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    expected = duck.execute(ORACLES[name])
    columns = [column[0] for column in expected.description]
    assert sorted(frame.columns) == sorted(columns)
    wanted = by_column_name(columns, expected.fetchall())
    found = by_column_name(frame.columns, [tuple(row) for row in frame.collect()])
    assert found == wanted
    if FOLDER.endswith("sf0.01"):
        assert found


def test_money_and_dates_as_they_are(spark, duck):
    """DECIMAL and DATE columns before they are made comparable to other engines."""
    orders = standins.order_store(spark, FOLDER)
    found = run_report("store_month_revenue", orders).select("store_id", "month", "revenue")
    assert found.schema["revenue"].dataType.simpleString() == "decimal(20,2)"
    expected = duck.execute(
        "SELECT n_nationkey, strftime(l_shipdate, '%Y-%m'), "
        "round(sum(CAST(l_extendedprice AS DECIMAL(24,6))), 2) FROM lineitem "
        "JOIN supplier ON s_suppkey = l_suppkey "
        "JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2"
    )
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
    events = standins.event_store(spark, FOLDER)
    found = run_report("daily_counts", events)
    assert found.schema["rental_day"].dataType.simpleString() == "date"
    expected = duck.execute("SELECT CAST(ts AS DATE), count(*) FROM events GROUP BY 1")
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 150
