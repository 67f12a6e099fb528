"""Tables kept as files, one folder or file per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.sources.evolving import is_file, table_schema

# Formats that carry their schema; reading one takes the file footers, not the data.
FORMATS = ("parquet", "orc")
# Files of a micro-batch, so that a table of any size is taken in bounded steps.
FILES_PER_BATCH = 1000


def table_path(folder: str, name: str, fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"tables are {' or '.join(FORMATS)}, not {fmt!r}")
    return f"{folder.rstrip('/')}/{name}.{fmt}"


def ignoring_case(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame with text columns that compare, group, join and sort without regard to
    case, as text does in the store's own database."""
    if not names:
        return frame
    return frame.withColumns({name: F.collate(F.col(name), "UTF8_LCASE") for name in names})


def read_table(
    spark: SparkSession,
    folder: str,
    name: str,
    fmt: str = "parquet",
    schema: StructType | None = None,
    ledger: str | None = None,
    ignore_case: Sequence[str] = (),
) -> DataFrame:
    """The table ``name`` as it is now, with the columns of all its files.

    A column that some files lack is NULL there, one that got wider has its widest type,
    and files that hold one column as types without a common one are an error. A
    ``schema`` of the caller saves the look at the file footers, a ``ledger`` folder the
    look at those already seen. ``ignore_case`` names columns that compare without
    regard to case.
    """
    path = table_path(folder, name, fmt)
    reader = spark.read.format(fmt)
    if schema is None and not is_file(spark, path):
        schema = table_schema(spark, path, fmt, ledger)
    table = (reader if schema is None else reader.schema(schema)).load(path)
    return ignoring_case(table, ignore_case)


def stream_table(
    spark: SparkSession,
    folder: str,
    name: str,
    files_per_batch: int = FILES_PER_BATCH,
    schema: StructType | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """The same Parquet table as a stream of its files, some at a time.

    Its columns are those of the files at the start; a file that comes later with more of
    them, or wider ones, takes a new start from the same progress.
    """
    path = table_path(folder, name, "parquet")
    schema = schema or table_schema(spark, path, "parquet", ledger)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # A stream takes a single file only through a glob, a folder either way.
    return reader.parquet(path.removesuffix("t") + "[t]")
