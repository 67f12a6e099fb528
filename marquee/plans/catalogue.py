"""Every query by name, over the test tables of one folder.

A query is a report of ``store_queries`` on one of three stand-in stores, or one
of the few at the end that need tables in another shape.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import (
    WEEKDAYS,
    date_text,
    days_in_month,
    field,
    parse_date,
    parse_month,
    parse_timestamp,
    weekday_name,
)
from marquee.operators import counts, overdue, periods, preferences, quantiles, scans
from marquee.plans.kept_cube import KeptCube
from marquee.plans.store_queries import STORE_QUERIES, Choices, calendar_reports
from marquee.session import remove_folder, shared_folder
from marquee.sources import ignoring_case, read_table, run_sql, standins, stream_table
from marquee.streaming import hourly

Query = Callable[[SparkSession, str], DataFrame]

# The test events cover January 2024, the test orders 1995 to 2001.
EVENT_CHOICES = Choices(
    single_day="2024-01-14",
    hour_outlier="2024-01-14",
    weekday_outlier="2024-01-14",
    first_day="2024-01-05",
    last_day="2024-01-20",
)
ORDER_CHOICES = Choices(
    hour_outlier="1998-02", weekday_outlier="1998", revenue_period="1997"
)
# Events from here on come first, where a stream takes them out of order.
LATER = "ts >= TIMESTAMP_NTZ '2024-01-16'"


def plain_types(frame: DataFrame) -> DataFrame:
    """BIGINT, DOUBLE and text instead of INT, DECIMAL and DATE, to compare engines."""
    plain = {"int": "bigint", "decimal": "double", "date": "string"}
    columns = []
    for name, kind in frame.dtypes:
        target = plain.get(kind.split("(")[0], kind)
        columns.append(f"CAST(`{name}` AS {target}) AS `{name}`")
    return frame.selectExpr(*columns)


def on_store(name: str, store: Callable, report: str, choices: Choices) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plain_types(STORE_QUERIES[report](store(spark, folder), choices))

    query.__name__ = name
    return query


# Reports that need a time of day.
ON_EVENTS = (
    "daily_counts",
    "hour_cube",
    "hourly_counts",
    "single_day_hours",
    "spike_slot_by_month",
    "weekday_counts",
    "weekday_hour_counts",
    "weekday_hour_counts_excluding",
    "date_hour_counts",
    "heat_hour_day",
    "heat_hour_day_excluding",
    "heat_weekday_hour",
    "heat_weekday_hour_excluding",
    "heat_date_hour",
    "hourly_peak",
    "weekday_peak",
    "top_slots",
    "top_slots_positional",
    "slot_outliers",
    "rental_scan",
)

# Reports over several years or with payments: query name and report.
ON_ORDERS = {
    "monthly_volume_revenue": "monthly_volume_revenue",
    "period_revenue": "period_revenue",
    "store_month_operating_days": "store_month_operating_days",
    "store_month_revenue": "store_month_revenue",
    "month_labels": "month_labels",
    "heat_month_day": "heat_month_day",
    "heat_hour_day_excluding_month": "heat_hour_day_excluding",
    "heat_weekday_hour_excluding_year": "heat_weekday_hour_excluding",
    "weekday_hour_counts_excluding_year": "weekday_hour_counts_excluding",
}

# Reports on items, with the supplier as item and the region as genre.
ON_ITEMS = {
    "top_region_per_customer": "top_category_per_customer",
    "monthly_overdue_rate_by_nation": "monthly_overdue_rate",
    "rental_return_dates": "rental_return_dates",
}


def top_category_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    """The part type as genre: one table stands for the whole catalogue."""
    rented = standins.rented_items(spark, folder, "l_partkey")
    genres = standins.part_genres(spark, folder)
    return preferences.top_category_per_customer(
        standins.customers(spark, folder), rented.join(genres, "inventory_id")
    )


def monthly_overdue_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The part size as allowed days."""
    rented = standins.rented_items(spark, folder, "l_partkey")
    durations = standins.part_durations(spark, folder)
    return overdue.monthly_overdue_rate(rented.join(durations, "inventory_id"))


def weekday_hour_counts_from_cube(spark: SparkSession, folder: str) -> DataFrame:
    """A report on the hour cube instead of the rentals."""
    cube = counts.HourCube(counts.hour_cube(standins.event_rentals(spark, folder)))
    return STORE_QUERIES["weekday_hour_counts"]({"rental": cube}, EVENT_CHOICES)


def table_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scans.whole_table(read_table(spark, folder, "customer"))


def daily_counts_sql(spark: SparkSession, folder: str) -> DataFrame:
    """SQL text with names in another language, grouping and ordering by an alias."""
    return run_sql(
        spark,
        "SELECT trunc(d.day, 'WEEK') AS `주`, count(DISTINCT d.day) AS `일수`, "
        "sum(d.n) AS `대여` FROM ("
        "SELECT CAST(rental_date AS DATE) AS day, count(rental_id) AS n "
        "FROM {rental} GROUP BY ALL) AS d "
        "GROUP BY `주` ORDER BY `주`",
        {"rental": standins.event_rentals(spark, folder)},
    )


def stream_hourly_revenue(
    spark: SparkSession, folder: str, target: str | None = None
) -> DataFrame:
    """With a ``target`` folder the stream goes on where it stopped there."""
    events = stream_table(spark, folder, "events")
    run = hourly.HourlyRevenue(events, "ts", "value", "event_type", target).run()
    return run.totals()


def stream_surge(
    spark: SparkSession, folder: str, target: str | None = None
) -> DataFrame:
    events = stream_table(spark, folder, "events")
    return hourly.Surges(events, "ts", folder=target).run().surges()


def weekday_counts_by_field(spark: SparkSession, folder: str) -> DataFrame:
    """Weekdays put in order by their place in a list of names."""
    facts = standins.event_rentals(spark, folder)
    named = counts.count_by(facts, "rental_date", ["weekday_no"]).select(
        weekday_name(F.col("weekday_no")).alias("weekday"), "rentals"
    )
    place = field(F.col("weekday"), *WEEKDAYS).alias("place")
    return named.select(place, "weekday", "rentals").orderBy("place")


def parsed_order_months(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per month text, with the days of the month that the text names, and what
    becomes of texts that name none."""
    text = date_text(F.col("rental_date"), "%Y-%m")
    months = standins.order_rentals(spark, folder).groupBy(text.alias("month"))
    return months.agg(F.count(F.lit(1)).alias("rentals")).select(
        "month",
        "rentals",
        days_in_month(parse_month(F.col("month"))).alias("days"),
        parse_date(F.col("month")).alias("no_date"),
    )


def parsed_event_times(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour of their timestamps read back from text, every seventh of
    which is spoilt and has none."""
    facts = standins.event_rentals(spark, folder)
    text = F.col("rental_date").cast("string")
    spoilt = F.when(F.col("rental_id") % 7 == 0, F.concat(text, F.lit("?"))).otherwise(text)
    stamps = facts.select(parse_timestamp(spoilt).alias("rental_date"))
    return counts.hourly_counts(stamps)


def weekday_matrix_from_written_cube(spark: SparkSession, folder: str) -> DataFrame:
    """One of the reports that share one scan of the rentals."""
    reports = calendar_reports(spark, standins.event_rentals(spark, folder))
    return reports["heat_weekday_hour"]


def generations(spark: SparkSession, folder: str, home: str) -> None:
    """The orders as files of three generations: months became a wider number, dates got
    a time of day, and customers and prices were added."""
    orders = read_table(spark, folder, "orders")
    year = "year(o_orderdate)"
    month = f"{year} * 100 + month(o_orderdate)"
    columns = (
        ("1997", f"CAST({month} AS INT) AS month", "CAST(o_orderdate AS DATE) AS rental_date"),
        ("1999", f"CAST({month} AS INT) AS month", "CAST(o_orderdate AS DATE) AS rental_date",
         "o_custkey AS customer_id"),
        ("9999", f"CAST({month} AS BIGINT) AS month", "o_orderdate AS rental_date",
         "o_custkey AS customer_id", "o_totalprice AS price"),
    )
    first = "0"
    for before, *chosen in columns:
        part = orders.where(f"coalesce({year}, 0) >= {first} AND coalesce({year}, 0) < {before}")
        part = part.selectExpr("o_orderkey AS rental_id", *chosen)
        part.write.mode("append").parquet(f"{home}/rental.parquet")
        first = before


def evolving_rental_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A table whose files hold different columns, read as one."""
    home = shared_folder(spark, "generations")
    generations(spark, folder, home)
    return read_table(spark, home, "rental", ledger=f"{home}/ledger")


def priced_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Rentals, payments in DECIMAL, and staff, for SQL texts."""
    tables = standins.order_store(spark, folder)
    paid = tables["payment"].withColumn("amount", F.col("amount").cast("decimal(24,6)"))
    return {"rental": tables["rental"], "payment": paid, "staff": tables["staff"]}


def monthly_volume_mysql(spark: SparkSession, folder: str) -> DataFrame:
    """MySQL text: a date pattern as the group, and the sum rounded."""
    text = """
        SELECT DATE_FORMAT(r.rental_date, '%Y-%m') AS month, COUNT(r.rental_id) AS rentals,
               ROUND(SUM(p.amount), 2) AS revenue
        FROM {rental} AS r INNER JOIN {payment} AS p ON p.rental_id = r.rental_id
        GROUP BY month ORDER BY month"""
    return run_sql(spark, text, priced_store(spark, folder), mysql=True)


def weekday_counts_mysql(spark: SparkSession, folder: str) -> DataFrame:
    """MySQL text: weekday names, put in order by a list of them."""
    days = ", ".join(f"'{day}'" for day in WEEKDAYS)
    text = f"""
        SELECT DATE_FORMAT(rental_date, '%W') AS weekday, COUNT(*) AS rentals,
               DATE_FORMAT(MIN(rental_date), '%e %M %Y, %H:%i') AS since
        FROM {{rental}} GROUP BY weekday
        ORDER BY FIELD(weekday, {days})"""
    tables = {"rental": standins.event_rentals(spark, folder)}
    return run_sql(spark, text, tables, mysql=True)


def store_days_mysql(spark: SparkSession, folder: str) -> DataFrame:
    """MySQL text: a subquery, two distinct counts, and the days of a month from its text."""
    text = """
        SELECT paid.store_id, paid.month, COUNT(DISTINCT paid.rental_id) AS rentals,
               COUNT(DISTINCT paid.day) AS days_open,
               DAY(LAST_DAY(STR_TO_DATE(CONCAT(paid.month, '-01'), '%Y-%m-%d'))) AS days
        FROM (SELECT s.store_id, p.rental_id, DATE(p.payment_date) AS day,
                     DATE_FORMAT(p.payment_date, '%Y-%m') AS month
              FROM {payment} AS p INNER JOIN {staff} AS s ON s.staff_id = p.staff_id) AS paid
        GROUP BY paid.store_id, paid.month"""
    return run_sql(spark, text, priced_store(spark, folder), mysql=True)


def date_hours_mysql(spark: SparkSession, folder: str) -> DataFrame:
    """MySQL text: dates as text and hours, between two texts, without a year."""
    text = """
        SELECT DATE_FORMAT(rental_date, '%Y-%m-%d') AS day, HOUR(rental_date) AS hour,
               COUNT(rental_id) AS rentals
        FROM {rental}
        WHERE rental_date BETWEEN '2024-01-05' AND '2024-01-20' AND YEAR(rental_date) != 2006
        GROUP BY day, hour ORDER BY day, hour"""
    tables = {"rental": standins.event_rentals(spark, folder)}
    return run_sql(spark, text, tables, mysql=True)


def stream_late_hours(spark: SparkSession, folder: str) -> DataFrame:
    """What a stream counts for hours that were closed: the later events come first."""
    home = shared_folder(spark, "out-of-order")
    events = read_table(spark, folder, "events")
    for part in (events.where(LATER), events.where(f"NOT coalesce({LATER}, false)")):
        part.write.mode("append").parquet(f"{home}/events.parquet")
        stream = stream_table(spark, home, "events")
        run = hourly.HourlyRevenue(stream, "ts", "value", "event_type", f"{home}/run").run()
    remove_folder(spark, f"{home}/events.parquet")
    return run.corrections()


def weekday_matrix_from_kept_cube(spark: SparkSession, folder: str) -> DataFrame:
    """A report on a cube that followed its table over two updates."""
    home = shared_folder(spark, "kept")
    events = read_table(spark, folder, "events")
    kept = KeptCube(spark, f"{home}/cube")
    for part in (events.where(f"NOT coalesce({LATER}, false)"), events.where(LATER)):
        part.write.mode("append").parquet(f"{home}/events.parquet")
        cube = kept.update(
            home, "events", lambda rows: rows.selectExpr("event_id AS rental_id", "ts AS rental_date")
        )
    remove_folder(spark, f"{home}/events.parquet")
    return STORE_QUERIES["heat_weekday_hour"]({"rental": cube}, EVENT_CHOICES)


def top_customer_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The busiest hours of single customers, by a quantile over very many groups."""
    kept = periods.outside("rental_date", EVENT_CHOICES.weekday_outlier)
    return quantiles.top_customer_slots(standins.event_rentals(spark, folder), kept)


def top_region_of_hot_items(spark: SparkSession, folder: str) -> DataFrame:
    """The genre report with its hot items dealt over several tasks."""
    tables = standins.item_store(spark, folder)
    rented = preferences.rented_genres(
        tables["rental"],
        tables["inventory"],
        tables["film"],
        tables["film_category"],
        tables["category"],
        spread=True,
    )
    return preferences.top_category_per_customer(tables["customer"], rented)


def top_genre_ignoring_case(spark: SparkSession, folder: str) -> DataFrame:
    """Part types in two spellings that count as one."""
    rented = standins.rented_items(spark, folder, "l_partkey")
    spelt = standins.part_genres(spark, folder).selectExpr(
        "inventory_id", "IF(inventory_id % 2 = 0, upper(genre), lower(genre)) AS genre"
    )
    return preferences.top_category_per_customer(
        standins.customers(spark, folder),
        rented.join(ignoring_case(spelt, ["genre"]), "inventory_id"),
    )


def plain(build: Query) -> Query:
    @wraps(build)
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plain_types(build(spark, folder))

    return query


QUERIES: dict[str, Query] = {
    **{
        name: on_store(name, standins.order_store, report, ORDER_CHOICES)
        for name, report in ON_ORDERS.items()
    },
    **{
        name: on_store(name, standins.event_store, name, EVENT_CHOICES)
        for name in ON_EVENTS
    },
    **{
        name: on_store(name, standins.item_store, report, Choices())
        for name, report in ON_ITEMS.items()
    },
    **{
        build.__name__: plain(build)
        for build in (
            top_category_per_customer,
            monthly_overdue_rate,
            weekday_hour_counts_from_cube,
            table_scan,
            daily_counts_sql,
            stream_hourly_revenue,
            stream_surge,
            weekday_counts_by_field,
            parsed_order_months,
            parsed_event_times,
            weekday_matrix_from_written_cube,
            evolving_rental_scan,
            monthly_volume_mysql,
            weekday_counts_mysql,
            store_days_mysql,
            date_hours_mysql,
            stream_late_hours,
            weekday_matrix_from_kept_cube,
            top_customer_slots,
            top_region_of_hot_items,
            top_genre_ignoring_case,
        )
    },
}
