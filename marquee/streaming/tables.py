"""Tables that the batches of a stream write, in a number of folders that stays small.

A batch that broke off is run again under its number, so everything is written under the
batch's number, counts once it is complete, and replaces what an earlier attempt left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.session import no_rows, remove_folder

# Folders of a tier that become one folder of the next.
FAN = 16


def complete_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders below one that a writer has ended."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    inside = [entry.getPath() for entry in store.listStatus(place)]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return [p.getName() for p in inside if store.exists(mark(p, "_SUCCESS"))]


@dataclass(frozen=True)
class Sums:
    """Counts and sums by key, to which every batch adds its own.

    A batch's part is a folder of tier 0, named by tier and last batch. Sixteen folders of
    a tier are summed into one of the next, so there are some sixteen per tier, a row is
    written again once per tier, and no batch reads what earlier ones have summed. Additions
    commute: files in any order, and in any number of batches, give the same table.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    keys: tuple[str, ...]

    def live(self) -> dict[tuple[int, int], str]:
        """Complete folders that no folder of a higher tier holds already."""
        names = complete_folders(self.spark, self.folder)
        known = [tuple(map(int, name.split("-")[1:])) for name in names if name.startswith("part-")]
        return {
            (tier, last): f"{self.folder}/part-{tier}-{last}"
            for tier, last in known
            if not any(t > tier and e - FAN**t < last <= e for t, e in known)
        }

    def summed(self, frame: DataFrame) -> DataFrame:
        rest = [f for f in self.schema if f.name not in self.keys]
        if not rest:
            return frame.select(*self.keys).distinct()
        sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in rest]
        return frame.groupBy(*self.keys).agg(*sums).select(*self.schema.names)

    def add(self, frame: DataFrame, number: int) -> None:
        """The part of a batch, summed by key or not; without effect where it is in a
        higher tier already."""
        if any(t and e - FAN**t < number <= e for t, e in self.live()):
            return
        path = f"{self.folder}/part-0-{number}"
        frame.select(*self.schema.names).write.mode("overwrite").parquet(path)
        tier = 1
        while (number + 1) % FAN**tier == 0:
            low = number - FAN**tier
            parts = [p for (t, e), p in self.live().items() if t == tier - 1 and low < e <= number]
            together = self.summed(self.spark.read.schema(self.schema).parquet(*parts))
            together.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/part-{tier}-{number}")
            tier += 1
        self.clear()

    def clear(self) -> None:
        """Deletes folders whose rows a higher tier holds."""
        live = {path.rsplit("/", 1)[-1] for path in self.live().values()}
        for name in complete_folders(self.spark, self.folder):
            if name not in live:
                remove_folder(self.spark, f"{self.folder}/{name}")

    def part(self, number: int) -> DataFrame | None:
        """What one batch added, as long as it has a folder of its own."""
        path = self.live().get((0, number))
        return path and self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        """The parts as they lie, to be summed by key."""
        parts = sorted(self.live().values())
        if not parts:
            return no_rows(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*parts)

    def table(self) -> DataFrame:
        return self.summed(self.rows())


@dataclass(frozen=True)
class Carried:
    """A few rows that a batch leaves to the next; the last two batches' are kept."""

    spark: SparkSession
    folder: str
    schema: StructType

    def numbers(self) -> Iterator[int]:
        for name in complete_folders(self.spark, self.folder):
            if name.startswith("after-"):
                yield int(name.split("-")[1])

    def before(self, number: int | None = None) -> DataFrame:
        """Rows left by the batch before this one, or by the last of all."""
        earlier = [n for n in self.numbers() if number is None or n < number]
        if not earlier:
            return no_rows(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/after-{max(earlier)}")

    def keep(self, frame: DataFrame, number: int) -> None:
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/after-{number}")
        for n in list(self.numbers()):
            if n < number - 1:
                remove_folder(self.spark, f"{self.folder}/after-{n}")
