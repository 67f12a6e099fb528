"""Rental-store tables laid over the TPC-H-like test tables.

``FIXTURES.md`` has the mapping. Every table is a projection, apart from
``rented_items``, whose rental and return dates live in two tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.sources.files import read_table


class LazyTables(dict):
    """Tables that are opened when a report first asks for them."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        openers: dict[str, Callable[[SparkSession, str], DataFrame]],
    ):
        super().__init__()
        self.source = (spark, folder)
        self.openers = openers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.openers[name](*self.source)
        return self[name]


def projection(table: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def open_table(spark: SparkSession, folder: str) -> DataFrame:
        return read_table(spark, folder, table).selectExpr(*columns)

    return open_table


# Rentals with a time of day; all columns of the table.
event_rentals = projection(
    "events",
    "event_id AS rental_id",
    "ts AS rental_date",
    "user_id AS customer_id",
    "event_type",
    "value",
    "props",
)
# Rentals that join with payments, always at midnight.
order_rentals = projection(
    "orders",
    "o_orderkey AS rental_id",
    "o_orderdate AS rental_date",
    "o_custkey AS customer_id",
)
payments = projection(
    "lineitem",
    "l_linenumber AS payment_id",
    "l_orderkey AS rental_id",
    "l_suppkey AS staff_id",
    "l_extendedprice AS amount",
    "l_shipdate AS payment_date",
)
staff = projection("supplier", "s_suppkey AS staff_id", "s_nationkey AS store_id")
stores = projection("nation", "n_nationkey AS store_id")
customers = projection(
    "customer",
    "c_custkey AS customer_id",
    "c_name AS first_name",
    "c_mktsegment AS last_name",
)
# Part as the whole catalogue: item to genre, item to allowed days.
part_genres = projection("part", "p_partkey AS inventory_id", "p_type AS genre")
part_durations = projection(
    "part", "p_partkey AS inventory_id", "p_size AS rental_duration"
)
# Supplier, nation and region as the catalogue in four tables.
inventory = projection(
    "supplier", "s_suppkey AS inventory_id", "s_nationkey AS film_id"
)
films = projection(
    "nation", "n_nationkey AS film_id", "n_nationkey AS rental_duration"
)
film_categories = projection(
    "nation", "n_nationkey AS film_id", "n_regionkey AS category_id"
)
categories = projection("region", "r_regionkey AS category_id", "r_name AS name")


def rented_items(
    spark: SparkSession, folder: str, item: str = "l_suppkey"
) -> DataFrame:
    """One row per rented item: an order line with the date of its order.

    Both sides are scans, so Spark can split an order with very many lines over
    several tasks at run time. The lines come first: a sort-merge join streams its
    first side and holds the rows of one key of the second, here one order.
    """
    lines = read_table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS rental_id",
        f"{item} AS inventory_id",
        "l_shipdate AS return_date",
    )
    return lines.join(order_rentals(spark, folder), "rental_id")


def event_store(spark: SparkSession, folder: str) -> LazyTables:
    return LazyTables(spark, folder, {"rental": event_rentals})


def order_store(spark: SparkSession, folder: str) -> LazyTables:
    return LazyTables(
        spark,
        folder,
        {
            "rental": order_rentals,
            "payment": payments,
            "staff": staff,
            "store": stores,
        },
    )


def item_store(spark: SparkSession, folder: str) -> LazyTables:
    return LazyTables(
        spark,
        folder,
        {
            "rental": rented_items,
            "customer": customers,
            "inventory": inventory,
            "film": films,
            "film_category": film_categories,
            "category": categories,
        },
    )
