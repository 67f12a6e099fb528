"""One schema for all files of a table whose columns came and widened over time.

Spark reads the footers, in a job over all files. Where these hold types that it does not
put together (INT in old files, BIGINT in new ones), the files are halved until each part has
one schema, and the parts' schemas are widened here to types that the readers turn all
of the files' values into. A ``ledger`` folder keeps what was found, so that later only
the footers of new files are read.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    ShortType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Each type holds all values of those before it.
LADDERS = (
    (ByteType(), ShortType(), IntegerType(), LongType()),
    (ByteType(), ShortType(), IntegerType(), DoubleType()),
    (FloatType(), DoubleType()),
    (DateType(), TimestampNTZType()),
)
MOST_DIGITS = 38
# What Spark says of files that it cannot put together.
CONFLICTS = ("CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE")


def widened(one: DataType, two: DataType, where: str) -> DataType:
    """The narrowest type for the values of both; an error where there is none."""
    if one == two or isinstance(two, NullType):
        return one
    if isinstance(one, NullType):
        return two
    for ladder in LADDERS:
        if one in ladder and two in ladder:
            return max(one, two, key=ladder.index)
    if isinstance(one, DecimalType) and isinstance(two, DecimalType):
        scale = max(one.scale, two.scale)
        digits = max(one.precision - one.scale, two.precision - two.scale) + scale
        if digits <= MOST_DIGITS:
            return DecimalType(digits, scale)
    if isinstance(one, StructType) and isinstance(two, StructType):
        return merged(one, two, f"{where}.")
    if isinstance(one, ArrayType) and isinstance(two, ArrayType):
        return ArrayType(widened(one.elementType, two.elementType, f"{where}[]"))
    if isinstance(one, MapType) and isinstance(two, MapType):
        key = widened(one.keyType, two.keyType, f"{where} (key)")
        return MapType(key, widened(one.valueType, two.valueType, f"{where} (value)"))
    raise ValueError(
        f"files hold {where} as {one.simpleString()} and as {two.simpleString()}"
    )


def merged(one: StructType, two: StructType, where: str = "") -> StructType:
    """All columns of both, those of the first in front; names that differ in case only
    are one column, spelt as in the first."""
    later = {field.name.lower(): field for field in two}
    fields = []
    for field in one:
        other = later.pop(field.name.lower(), field)
        kind = widened(field.dataType, other.dataType, f"{where}{field.name}")
        fields.append(StructField(field.name, kind))
    rest = [f for f in two if f.name.lower() in later]
    return StructType([*fields, *(StructField(f.name, f.dataType) for f in rest)])


def footers(spark: SparkSession, fmt: str, paths: list[str]) -> StructType:
    """The files' columns as Spark merges them."""
    return spark.read.format(fmt).option("mergeSchema", True).load(paths).schema


def same_types(spark: SparkSession, fmt: str, paths: list[str]) -> StructType | None:
    """The files' columns, or None where Spark does not put them together."""
    try:
        return footers(spark, fmt, paths)
    except (PySparkException, Py4JJavaError) as found:
        if not any(name in str(found) for name in CONFLICTS):
            raise
    return None


def schema_of_files(spark: SparkSession, fmt: str, files: list[str]) -> StructType:
    """The merged schema of some files, by halves where their types differ."""
    if len(files) == 1:
        return footers(spark, fmt, files)
    found = same_types(spark, fmt, files)
    if found is not None:
        return found
    middle = len(files) // 2
    return merged(
        schema_of_files(spark, fmt, files[:middle]),
        schema_of_files(spark, fmt, files[middle:]),
    )


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, without a look into them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", "modificationTime", "length")


def is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(place).isFile()


def partition_columns(spark: SparkSession, fmt: str, path: str) -> list[StructField]:
    """Columns that stand in the names of the folders."""
    one = listing(spark, path).first()
    if one is None:
        return []
    below = one["path"].rsplit(path.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1]
    named = {f.split("=")[0].lower() for f in below.split("/")[:-1] if "=" in f}
    return [f for f in spark.read.format(fmt).load(path).schema if f.name.lower() in named]


def with_partitions(columns: StructType, parts: list[StructField]) -> StructType:
    names = {f.name.lower() for f in parts}
    return StructType([*(f for f in columns if f.name.lower() not in names), *parts])


def known_files(spark: SparkSession, ledger: str) -> tuple[DataFrame | None, StructType | None, int]:
    """Files and schema of the last complete entry, and its number."""
    place = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return None, None, -1
    numbers = [
        int(entry.getPath().getName().split("=")[1])
        for entry in store.listStatus(place)
        if store.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS"))
    ]
    if not numbers:
        return None, None, -1
    files = spark.read.parquet(f"{ledger}/entry={max(numbers)}")
    row = files.select("schema").first()
    schema = None if row is None else StructType.fromJson(json.loads(row["schema"]))
    return files.drop("schema"), schema, max(numbers)


def table_schema(
    spark: SparkSession, path: str, fmt: str = "parquet", ledger: str | None = None
) -> StructType:
    """Columns of all files below a path, in the order of the files' names.

    With a ``ledger`` folder, files that were there the last time, with the same length
    and time, are not looked into again. If one of those has gone or changed, all are: its
    columns may have gone with it. Two writers of one ledger may both read new footers;
    the later entry counts.
    """
    if is_file(spark, path):
        return spark.read.format(fmt).load(path).schema
    parts = partition_columns(spark, fmt, path)
    if ledger is None:
        columns = same_types(spark, fmt, [path])
        if columns is None:
            names = listing(spark, path).select("path").orderBy("path").collect()
            columns = schema_of_files(spark, fmt, [row["path"] for row in names])
        return with_partitions(columns, parts)

    files = listing(spark, path)
    before, schema, number = known_files(spark, ledger)
    if before is not None and before.exceptAll(files).isEmpty():
        new = files.exceptAll(before)
    else:
        new, schema = files, None
    names = [row["path"] for row in new.select("path").orderBy("path").collect()]
    if names:
        columns = schema_of_files(spark, fmt, names)
        schema = columns if schema is None else merged(schema, columns)
        text = F.lit(schema.json()).alias("schema")
        files.select("*", text).write.mode("overwrite").parquet(
            f"{ledger}/entry={number + 1}"
        )
    if schema is None:
        schema = spark.read.format(fmt).load(path).schema
    return with_partitions(schema, parts)
