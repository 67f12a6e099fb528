"""Reading, writing and batch helpers that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marquee.session import remove_folder, shared_folder

# Texts are handled in runs of about so many bytes: arrays stay in the cache.
RUN_BYTES = 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


class Tables:
    """Tables of one operator in the shared folder, to be deleted when it has ended."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def written(self, frame: DataFrame, purpose: str) -> DataFrame:
        """The frame as a table: an end to its lineage that survives lost executors,
        and a size that Spark knows."""
        spark = frame.sparkSession
        path = shared_folder(spark, purpose)
        self.paths.append((spark, path))
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    def delete(self) -> None:
        for spark, path in self.paths:
            remove_folder(spark, path)
        self.paths.clear()


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """A table that stays, as a result is made of it."""
    return Tables().written(frame, purpose)


def runs(sizes: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of consecutive items of about ``most`` bytes, one item at least."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield low, high
        low = high


def text_runs(
    batches: Iterator[pa.RecordBatch], column: str, most: int = RUN_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts; a null text is an empty one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0)
        for low, high in runs(np.asarray(lengths, dtype=np.int64) + 64, most):
            part = batch.slice(low, high - low)
            yield part, [t or "" for t in part.column(at).to_pylist()]


def groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the groups' bounds, from batches sorted by the keys.

    The last group of a batch waits for the next batch, in which it may go on.
    """
    rest: pa.Table | None = None

    def bounds(part: pa.Table) -> np.ndarray:
        new = np.zeros(part.num_rows, dtype=bool)
        new[0] = True
        for key in keys:
            values = part.column(key).combine_chunks()
            if isinstance(values, pa.ChunkedArray):
                values = values.chunk(0)
            after, before = values.slice(1), values.slice(0, len(values) - 1)
            new[1:] |= np.asarray(pc.not_equal(after, before))
        return np.append(np.flatnonzero(new), part.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        if rest is not None:
            part = pa.concat_tables([rest, part]).combine_chunks()
        edges = bounds(part)
        last = int(edges[-2])
        if last:
            yield part.slice(0, last), edges[:-1]
        rest = part.slice(last)
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


# A text may have any length, so what goes to Python at once is bounded by bytes.
BATCH_BYTES = 4 << 20


SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for a Spark application: they need
    not find it by a path of their own."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if context.applicationId in SHIPPED or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    SHIPPED.add(context.applicationId)


def give_back() -> None:
    """Returns free memory to the machine: workers stay on after a task, next to others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def by_arrow(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str
) -> Callable[[DataFrame], DataFrame]:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES`` (one row at least), for
    ``DataFrame.transform``. The bound is an option of the session."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    def apply(frame: DataFrame) -> DataFrame:
        ship_package(frame.sparkSession)
        frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return frame.mapInArrow(to_the_end, schema)

    return apply


def with_columns(
    frame: DataFrame,
    column: str,
    added: StructType,
    make: Callable[[list[str]], list],
) -> DataFrame:
    """The frame with columns made from its text column, one list or array each.

    An added column replaces one of the same name.
    """
    names = {f.name.lower() for f in added}
    kept = [c for c in frame.columns if c.lower() not in names]
    source = frame.select(*[f"`{c}`" for c in kept])
    schema = StructType([*source.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(added)
        for part, texts in text_runs(batches, column):
            columns = [pa.array(v, type=f.type) for v, f in zip(make(texts), out, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*kept, *out.names])

    return source.transform(by_arrow(run, schema))


def long_fields(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


def crc_of_id(column: str = "doc_id"):
    """crc32 of the number as decimal text."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary"))
