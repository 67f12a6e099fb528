"""SQL texts with MySQL's functions."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from handmade import RENTAL, random_rentals

from marquee.sources import run_sql
from marquee.sources.dialect import WRITTEN, spark_text

MOMENT = datetime(2005, 7, 3, 9, 4, 5, 60)
# What MySQL's manual says of each mark, for the moment above.
SHOWN = {
    "%Y": "2005", "%y": "05", "%m": "07", "%c": "7", "%M": "July", "%b": "Jul", "%d": "03", "%e": "3",
    "%j": "184", "%W": "Sunday", "%a": "Sun", "%H": "09", "%k": "9", "%h": "09", "%I": "09", "%l": "9",
    "%i": "04", "%s": "05", "%S": "05", "%f": "000060", "%p": "AM", "%T": "09:04:05", "%r": "09:04:05 AM",
    "%%": "%", "%Y-%m": "2005-07", "%Y년 %c월": "2005년 7월", "at %H o'clock": "at 09 o'clock",
    "%Yat%m": "2005at07", "100%% [%d] #{%m}": "100% [03] #{07}", "%%Y": "%Y", "day": "day", "": "",
}


@pytest.fixture(scope="module")
def moments(spark):
    frame = spark.createDataFrame([(MOMENT, p) for p in SHOWN], "t TIMESTAMP_NTZ, p STRING")
    return {"f": frame}


def one(spark, text, tables=None):
    return run_sql(spark, text, tables, mysql=True).collect()


def test_every_mark_is_tried():
    assert set(WRITTEN) <= set(SHOWN)


def test_patterns_from_a_column(spark, moments):
    rows = one(spark, "SELECT p, DATE_FORMAT(t, p) AS shown FROM {f}", moments)
    assert {r.p: r.shown for r in rows} == SHOWN


def test_constant_patterns_are_translated_while_planning(spark, moments):
    frame = run_sql(spark, "SELECT date_format(t, '%Y-%m') AS m FROM {f}", moments, mysql=True)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "yyyy-MM" in plan and "replace" not in plan and "UDF" not in plan and "%Y" not in plan
    assert {r.m for r in frame.collect()} == {"2005-07"}


def test_other_types_and_null(spark):
    (row,) = one(
        spark,
        "SELECT DATE_FORMAT(DATE '2005-07-03', '%Y/%m/%d') AS a, DATE_FORMAT(NULL, '%Y') AS b, "
        "DATE_FORMAT(TIMESTAMP_NTZ '2005-07-03 23:59:59', '%T') AS c, DATE_FORMAT('2005-07-03 01:02:03', '%H%i') AS d",
    )
    assert tuple(row) == ("2005/07/03", None, "23:59:59", "0102")


def test_unknown_mark_is_an_error(spark):
    with pytest.raises(Exception, match="no such mark"):
        one(spark, "SELECT DATE_FORMAT(DATE '2005-07-03', '%Q')")
    with pytest.raises(Exception, match="no such mark"):
        one(spark, "SELECT STR_TO_DATE('2005-07-03 10', '%Y-%m-%d %H')")


def test_str_to_date(spark):
    (row,) = one(
        spark,
        "SELECT STR_TO_DATE('2005-07-03', '%Y-%m-%d') AS a, STR_TO_DATE('3.7.2005', '%d.%m.%Y') AS b, "
        "STR_TO_DATE('none', '%Y-%m-%d') AS c, STR_TO_DATE(CONCAT('2005-02', '-30'), '%Y-%m-%d') AS d, "
        "STR_TO_DATE(NULL, '%Y') AS e, STR_TO_DATE('July 4, 2005', '%M %e, %Y') AS f",
    )
    assert tuple(row) == (date(2005, 7, 3), date(2005, 7, 3), None, None, None, date(2005, 7, 4))


def test_field_as_a_function(spark):
    (row,) = one(
        spark,
        "SELECT FIELD(upper('b'), 'A', 'B') AS a, FIELD('z', 'A', 'B') AS b, FIELD(NULL, 'A') AS c, "
        "FIELD(3, 1, 2, 3) AS d, FIELD('x', 'x', 'x') AS e, FIELD(concat('a', ','), 'a', 'a,') AS f",
    )
    assert tuple(row) == (2, 0, 0, 3, 1, 2)


def test_order_by_field(spark):
    frame = spark.createDataFrame([("x",), ("b",), (None,), ("it's",), ("a",)], "`the name` STRING")
    rows = one(spark, "SELECT * FROM {f} AS f ORDER BY FIELD(f.`the name`, 'b', 'it''s', \"a\"), `the name`", {"f": frame})
    assert [r[0] for r in rows] == [None, "x", "b", "it's", "a"]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 'DATE_FORMAT(x, y) FIELD(a, 1)'", 'SELECT "FIELD(a, \'b\')"', "SELECT 1 -- FIELD(a, 'b') DATE_FORMAT(",
        "SELECT /* DATE_FORMAT(a) */ 1", "SELECT `date_format(`", "SELECT my_field(a, 'b'), field_date_format(a)",
        "SELECT date_format FROM t", "SELECT 'it''s' AS `FIELD(a,'b')`", r"SELECT 'a\'FIELD(a, 1)'",
    ],
)
def test_quotes_comments_and_longer_names_stay(text):
    assert spark_text(text) == text


def test_spark_dialect_is_as_before(spark):
    assert run_sql(spark, "SELECT date_format(DATE '2005-07-03', 'yyyy') AS y").first().y == "2005"


def test_report_in_mysql_text(spark):
    """Counts by month and weekday with grouping by alias, a subquery and days of the month."""
    rental = spark.createDataFrame(random_rentals(seed=5, size=400), RENTAL)
    rows = one(
        spark,
        "SELECT m.`월`, COUNT(*) AS n, DAY(LAST_DAY(STR_TO_DATE(CONCAT(m.`월`, '-01'), '%Y-%m-%d'))) AS days "
        "FROM (SELECT DATE_FORMAT(rental_date, '%Y-%m') AS `월` FROM {rental} WHERE rental_date IS NOT NULL) AS m "
        "GROUP BY m.`월` ORDER BY m.`월`",
        {"rental": rental},
    )
    dates = [r.rental_date for r in rental.collect() if r.rental_date]
    months = sorted({f"{d:%Y-%m}" for d in dates})
    assert [r[0] for r in rows] == months
    assert [r.n for r in rows] == [sum(f"{d:%Y-%m}" == m for d in dates) for m in months]
    weekdays = one(
        spark,
        "SELECT DATE_FORMAT(rental_date, '%W') AS weekday, COUNT(*) AS n FROM {rental} WHERE rental_date IS NOT NULL "
        "GROUP BY weekday ORDER BY FIELD(weekday, 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday')",
        {"rental": rental},
    )
    assert [r.weekday for r in weekdays] == [
        w for i, w in enumerate("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()) if any(d.weekday() == i for d in dates)
    ]
