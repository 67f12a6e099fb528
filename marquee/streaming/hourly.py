"""Hourly revenue and surges on a stream (additions of this package).

Nothing is kept in Spark's state store. A batch adds its counts and sums per hour to a table
that grows by additions alone, and leaves a few rows to the next batch: the latest hour
seen and, for surges, the hours still open and one row per weekday and hour. An hour is
open until a row ``delay`` hours after it has come. Rows for a closed hour are late: they
count in the totals, and stand in a table of corrections too, so that whoever took a closed
hour for final can mend it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.functions import Money, as_utc, hour_from_utc
from marquee.session import no_rows, shared_folder
from marquee.streaming.tables import Carried, Sums

DELAY = 48
LATEST = StructType().add("latest", "timestamp_ntz")
RENTALS = StructType().add("hour_start", "timestamp_ntz").add("rentals", "long")
# Open hours, and without an hour the sums of a slot's closed ones.
CARRIED = (
    StructType().add("hour_start", "timestamp_ntz").add("weekday_no", "integer").add("hour", "integer")
    .add("hours", "long").add("total", "long")
)
SLOT = ("weekday_no", "hour", "hours", "total")
SURGES = StructType([*RENTALS.fields]).add("usual", "double")


def hour_of(when: str) -> Column:
    """The full hour of a naive timestamp."""
    return hour_from_utc(as_utc(F.col(when).cast("timestamp_ntz")))


def hourly_totals(rows: DataFrame, when: str, amount: str, kind: str) -> DataFrame:
    """Rows and exact amounts per hour and kind; rows without a time are left out."""
    money = Money.of(rows, amount)
    return (
        rows.where(F.col(when).isNotNull())
        .groupBy(hour_of(when).alias("hour_start"), F.col(kind).alias("kind"))
        .agg(F.count(F.lit(1)).alias("rentals"), F.sum(money.summand()).alias("total"))
    )


def hourly_rentals(rows: DataFrame, when: str) -> DataFrame:
    """Rows per hour; rows without a time are left out."""
    return (
        rows.where(F.col(when).isNotNull())
        .groupBy(hour_of(when).alias("hour_start"))
        .agg(F.count(F.lit(1)).alias("rentals"))
    )


def slot_of_hour() -> list[Column]:
    return [F.weekday(F.to_date("hour_start")).alias("weekday_no"), F.hour("hour_start").alias("hour")]


def judged(hours: DataFrame, slots: DataFrame, factor: float) -> DataFrame:
    """Hours (one row each) with more than ``factor`` times the usual count of their slot.

    Usual is the mean of the earlier hours of the same weekday and hour: those that
    ``slots`` sums up and those here that come before. An hour without earlier ones
    never surges.
    """
    earlier = (
        Window.partitionBy("weekday_no", "hour")
        .orderBy("hour_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    before = F.coalesce("hours", zero) + F.count("rentals").over(earlier)
    total = F.coalesce("total", zero) + F.coalesce(F.sum("rentals").over(earlier), zero)
    return (
        hours.select("hour_start", "rentals", *slot_of_hour())
        .join(slots, ["weekday_no", "hour"], "left")
        .withColumn("usual", F.try_divide(total.cast("double"), before))
        .where(F.col("rentals") > F.lit(factor) * F.col("usual"))
        .select("hour_start", "rentals", "usual")
    )


def surging_hours(hours: DataFrame, factor: float = 1.5) -> DataFrame:
    """The same over hours that are all at hand."""
    return judged(hours, no_rows(hours.sparkSession, CARRIED).select(*SLOT), factor)


def latest_hour(hours: DataFrame, column: str = "hour_start") -> datetime | None:
    return hours.agg(F.max(column)).first()[0]


def closed_by(latest: datetime | None, delay: int) -> Column:
    """Whether an hour is closed once the latest one has been seen."""
    seen = F.lit(latest and str(latest)).cast("timestamp_ntz")
    before = F.col("hour_start") < seen - F.make_dt_interval(hours=F.lit(delay))
    return F.coalesce(before, F.lit(False))


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str
) -> None:
    """Runs a stream over the input at hand, from where its folder says it stopped."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class HourlyRevenue:
    """Rows and revenue per hour and kind of a stream, whose files come in any order."""

    def __init__(
        self, stream: DataFrame, when: str, amount: str, kind: str,
        folder: str | None = None, delay: int = DELAY,
    ):
        spark = stream.sparkSession
        self.stream, self.columns, self.delay = stream, (when, amount, kind), delay
        self.folder = folder or shared_folder(spark, "hourly-revenue")
        self.money = Money.of(stream, amount)
        schema = hourly_totals(stream, *self.columns).schema.add("late", "boolean")
        self.sums = Sums(spark, f"{self.folder}/hours", schema, ("hour_start", "kind", "late"))
        self.latest = Carried(spark, f"{self.folder}/latest", LATEST)

    def write(self, batch: DataFrame, number: int) -> None:
        before = self.latest.before(number)
        late = closed_by(latest_hour(before, "latest"), self.delay)
        self.sums.add(hourly_totals(batch, *self.columns).withColumn("late", late), number)
        added = self.sums.part(number)
        if added is None:  # the last of sixteen: summed up with the others
            added = hourly_totals(batch, *self.columns)
        seen = added.select(F.col("hour_start").alias("latest")).unionAll(before)
        self.latest.keep(seen.agg(F.max("latest").alias("latest")), number)

    def run(self) -> HourlyRevenue:
        run_available(self.stream, self.write, self.folder)
        return self

    def rounded(self, *keys: str, late: bool = False) -> DataFrame:
        rows = self.sums.rows()
        rows = rows.where("late") if late else rows
        sums = [F.sum("rentals").alias("rentals"), self.money.rounded(F.sum("total")).alias("revenue")]
        return rows.groupBy(*keys).agg(*sums)

    def totals(self) -> DataFrame:
        """All hours at hand, open and late rows included."""
        return self.rounded("hour_start", "kind")

    def corrections(self) -> DataFrame:
        """What came for hours after they were closed."""
        return self.rounded("hour_start", "kind", late=True)


class Surges:
    """Surging hours of a stream, each judged once, when it is closed.

    What is read per batch are its rows, the open hours and 168 slots; older hours are not
    looked at again. Late rows change no verdict.
    """

    def __init__(
        self, stream: DataFrame, when: str, factor: float = 1.5,
        folder: str | None = None, delay: int = DELAY,
    ):
        spark = stream.sparkSession
        self.stream, self.when = stream, when
        self.factor, self.delay = factor, delay
        self.folder = folder or shared_folder(spark, "surges")
        self.found = Sums(spark, f"{self.folder}/surges", SURGES, tuple(SURGES.names))
        self.late = Sums(spark, f"{self.folder}/late", RENTALS, ("hour_start",))
        self.carried = Carried(spark, f"{self.folder}/carried", CARRIED)

    def left(self, number: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Open hours and slots as a batch, or the last one, left them."""
        rows = self.carried.before(number)
        hours = rows.where("hour_start IS NOT NULL").select("hour_start", F.col("total").alias("rentals"))
        return hours, rows.where("hour_start IS NULL").select(*SLOT)

    def write(self, batch: DataFrame, number: int) -> None:
        hours, slots = self.left(number)
        counts = hourly_rentals(batch, self.when).persist()
        latest = latest_hour(hours)
        late = closed_by(latest, self.delay)
        if latest is not None:
            self.late.add(counts.where(late), number)
        pending = counts.where(~late).unionAll(hours).groupBy("hour_start")
        pending = pending.agg(F.sum("rentals").alias("rentals")).persist()
        closes = closed_by(latest_hour(pending), self.delay)
        closing = pending.where(closes)
        self.found.add(judged(closing, slots, self.factor), number)
        one = F.lit(1).cast("long").alias("hours")
        each = [*slot_of_hour(), one, F.col("rentals").alias("total")]
        sums = [F.sum(c).alias(c) for c in ("hours", "total")]
        slots = slots.unionAll(closing.select(*each)).groupBy("weekday_no", "hour").agg(*sums)
        slots = slots.select(F.lit(None).cast("timestamp_ntz").alias("hour_start"), *SLOT)
        self.carried.keep(slots.unionAll(pending.where(~closes).select("hour_start", *each)), number)
        for frame in (counts, pending):
            frame.unpersist()

    def run(self) -> Surges:
        run_available(self.stream, self.write, self.folder)
        return self

    def surges(self) -> DataFrame:
        """Surges among closed hours, and what the open ones are by now."""
        return self.found.table().unionAll(judged(*self.left(), self.factor))

    def corrections(self) -> DataFrame:
        """Rows that came for hours after they were judged."""
        return self.late.table()
