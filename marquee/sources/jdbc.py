"""Tables of a relational database, read in parallel ranges of a key."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from marquee.sources.files import ignoring_case


def connection_from_env(
    database: str, environ: dict[str, str] | None = None
) -> dict[str, str]:
    """Connection options from ``MYSQL_*`` variables; the password has no default."""
    env = os.environ if environ is None else environ
    if "MYSQL_PASSWORD" not in env:
        raise KeyError("MYSQL_PASSWORD is not set")
    host = env.get("MYSQL_HOST", "127.0.0.1")
    port = env.get("MYSQL_PORT", "3306")
    return {
        # Without a cursor the driver loads the whole answer before the first row.
        "url": f"jdbc:mysql://{host}:{port}/{database}?useCursorFetch=true",
        "user": env.get("MYSQL_USER", "root"),
        "password": env["MYSQL_PASSWORD"],
    }


def jdbc_options(
    connection: dict[str, str],
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    ranges: int = 1,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Reader options. ``bounds`` only place the cuts; no row is left out."""
    options = {
        **connection,
        "dbtable": table,
        "fetchsize": str(fetch_rows),
        "preferTimestampNTZ": "true",
    }
    if key is not None:
        if bounds is None:
            raise ValueError("a range read needs the bounds of the key")
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(ranges),
        }
    return options


def jdbc_table(
    spark: SparkSession,
    connection: dict[str, str],
    table: str,
    key: str | None = None,
    ranges: int = 64,
    one_connection: bool = False,
    ignore_case: Sequence[str] = (),
) -> DataFrame:
    """A table as a frame, read over ``ranges`` connections by ranges of ``key``.

    Where ``one_connection`` is asked for, as suits staff and store tables, a single
    one reads everything; a table without a key, or with none but NULL keys, is not
    read in any other way. ``ignore_case`` names columns that compare without regard
    to case once they are here, as they do in the database.
    """
    reader = spark.read.format("jdbc")
    if key is None and not one_connection:
        raise ValueError("a table is read by ranges of a key, or over one_connection")
    if key is None:
        options = jdbc_options(connection, table)
        return ignoring_case(reader.options(**options).load(), ignore_case)
    edges = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) edges"
    found = spark.read.format("jdbc").options(**jdbc_options(connection, edges))
    lo, hi = found.load().first()
    if lo is None and not one_connection:
        raise ValueError(f"{table} has no {key} to cut it by; ask for one_connection")
    if lo is None:
        options = jdbc_options(connection, table)
    else:
        options = jdbc_options(connection, table, key, (lo, hi), ranges)
    return ignoring_case(reader.options(**options).load(), ignore_case)
