from marquee.sources.catalog import (
    inline_rows,
    list_tables,
    register_views,
    run_sql,
    use_database,
)
from marquee.sources.dialect import mysql_functions
from marquee.sources.evolving import table_schema
from marquee.sources.files import ignoring_case, read_table, stream_table
from marquee.sources.jdbc import connection_from_env, jdbc_options, jdbc_table

__all__ = [
    "connection_from_env",
    "ignoring_case",
    "inline_rows",
    "jdbc_options",
    "jdbc_table",
    "list_tables",
    "mysql_functions",
    "read_table",
    "register_views",
    "run_sql",
    "stream_table",
    "table_schema",
    "use_database",
]
