"""An hour cube that is kept, and follows its table file by file.

The cube lies in a folder per update and month. An update counts the rows of new files only,
adds to them what the months that they fall in had before, and writes those months into a
folder of its own; all other months stay where they are, untouched. A ledger entry, written
last, says which files are counted and which folder holds each month: without it
nothing has happened, so an update that breaks off is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.functions import month_start, month_text
from marquee.operators.counts import HourCube, hour_cube
from marquee.session import no_rows, remove_folder
from marquee.sources.evolving import is_file, listing, table_schema
from marquee.sources.files import table_path
from marquee.streaming.tables import complete_folders

WHEN, COUNTED = "rental_date", "rental_id"
CUBE = (
    StructType().add(WHEN, "timestamp_ntz").add("row_count", "long").add("id_count", "long")
)
# Rows without a time have a month of their own.
NO_MONTH = "none"


@dataclass(frozen=True)
class KeptCube:
    """The cube of one table in one folder; one writer at a time."""

    spark: SparkSession
    folder: str

    def last(self) -> int:
        """Number of the last complete update; -1 before the first."""
        done = [n for n in complete_folders(self.spark, f"{self.folder}/months") if "-" in n]
        return max((int(name.split("-")[1]) for name in done), default=-1)

    def homes(self, number: int) -> dict[str, int]:
        """The update that wrote each month, as of an update."""
        if number < 0:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/months/entry-{number}").collect()
        return {row["month"]: row["home"] for row in rows}

    def read(self, homes: dict[str, int]) -> DataFrame:
        paths = [f"{self.folder}/cube/update-{n}/month={month}" for month, n in homes.items()]
        if not paths:
            return no_rows(self.spark, CUBE)
        return self.spark.read.schema(CUBE).parquet(*paths)

    def cube(self) -> HourCube:
        return HourCube(self.read(self.homes(self.last())))

    def new_files(self, path: str, number: int) -> tuple[DataFrame, list[str] | None, bool]:
        """All files, the names of those not counted yet, and whether to begin anew: a
        file that was counted has gone or changed. No names stand for all files."""
        files = listing(self.spark, path)
        if number < 0:
            return files, None, True
        seen = self.spark.read.parquet(f"{self.folder}/files/entry-{number}")
        if not seen.exceptAll(files).isEmpty():
            return files, None, True
        new = files.exceptAll(seen).select("path").collect()
        return files, [row["path"] for row in new], False

    def update(
        self,
        tables: str,
        name: str,
        project: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        fmt: str = "parquet",
    ) -> HourCube:
        """Counts what has come to the table since; ``project`` gives its rows the store's
        names ``rental_id`` and ``rental_date``."""
        path, number = table_path(tables, name, fmt), self.last()
        files, names, anew = self.new_files(path, number)
        if names == []:
            return self.cube()
        reader = self.spark.read.format(fmt)
        reader = reader.schema(table_schema(self.spark, path, fmt, f"{self.folder}/schema"))
        if names and not is_file(self.spark, path):
            reader = reader.option("basePath", path)
        counted = self.in_months(hour_cube(project(reader.load(names or path)), WHEN, COUNTED))

        before, number = {} if anew else self.homes(number), number + 1
        work = f"{self.folder}/new"
        counted.write.mode("overwrite").parquet(work)
        counted = self.spark.read.schema(counted.schema).parquet(work)
        # A row per month of the history at most.
        months = [row["month"] for row in counted.select("month").distinct().collect()]
        old = self.read({month: n for month, n in before.items() if month in months})
        sums = [F.sum(c).alias(c) for c in ("row_count", "id_count")]
        whole = counted.unionAll(self.in_months(old)).groupBy("month", WHEN).agg(*sums)
        # One file per month: a month has 744 hours at most.
        whole.repartition("month").write.mode("overwrite").partitionBy("month").parquet(
            f"{self.folder}/cube/update-{number}"
        )
        homes = before | dict.fromkeys(months, number)
        files.write.mode("overwrite").parquet(f"{self.folder}/files/entry-{number}")
        pairs = self.spark.createDataFrame(sorted(homes.items()), "month STRING, home INT")
        pairs.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/months/entry-{number}")
        self.clear(homes, number)
        return self.cube()

    def in_months(self, hours: DataFrame) -> DataFrame:
        month = F.coalesce(month_text(month_start(F.col(WHEN))), F.lit(NO_MONTH))
        return hours.select(WHEN, "row_count", "id_count", month.alias("month"))

    def clear(self, homes: dict[str, int], number: int) -> None:
        """Deletes what no entry names any more; the entry before stays, for its readers."""
        remove_folder(self.spark, f"{self.folder}/new")
        needed = {*homes.values(), *self.homes(number - 1 if number else -1).values(), number}
        for name in complete_folders(self.spark, f"{self.folder}/cube"):
            if int(name.split("-")[1]) not in needed:
                remove_folder(self.spark, f"{self.folder}/cube/{name}")
        for part in ("files", "months"):
            for name in complete_folders(self.spark, f"{self.folder}/{part}"):
                if int(name.split("-")[1]) < number - 1:
                    remove_folder(self.spark, f"{self.folder}/{part}/{name}")
