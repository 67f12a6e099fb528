"""SQL surface: views, databases, table lists, inline rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from marquee.sources.dialect import mysql_functions, spark_text


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def use_database(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def list_tables(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Names of the current database's tables and the session's views, in order; a
    ``*`` in the pattern stands for any characters."""
    names = sorted(table.name for table in spark.catalog.listTables(pattern=pattern))
    return spark.createDataFrame([(name,) for name in names], "table_name STRING")


def run_sql(
    spark: SparkSession,
    text: str,
    tables: Mapping[str, DataFrame] | None = None,
    mysql: bool = False,
) -> DataFrame:
    """A SQL text as a lazy frame; ``{name}`` marks in it stand for ``tables``.

    With ``mysql``, ``DATE_FORMAT`` and ``STR_TO_DATE`` take ``%`` patterns and ``FIELD`` is known;
    the last two stay as functions of the session.
    """
    if mysql:
        mysql_functions(spark)
        text = spark_text(text)
    return spark.sql(text, **(tables or {}))


def inline_rows(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """Literal rows with a declared schema."""
    return spark.createDataFrame(list(rows), schema)
