from __future__ import annotations

import pathlib
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from marquee.session import CLUSTER_SETTINGS, shared_folder
from marquee.sources import stream_table
from marquee.streaming import hourly, tables

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, kind STRING, amount DOUBLE"
START = datetime(2005, 7, 1, 8)


def made(first, last):
    """Four rows per hour, every row in its own five minutes."""
    return [
        (i, START + timedelta(minutes=15 * i + i % 5), "ab"[i % 2], 0.99 + i)
        for i in range(first, last)
    ]


def write(spark, folder, rows, mode="append"):
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    frame.write.mode(mode).parquet(f"{folder}/events.parquet")


def hours_of(rows):
    tally, revenue = Counter(), Counter()
    for _, ts, kind, amount in rows:
        hour = ts.replace(minute=0, second=0)
        tally[hour, kind] += 1
        revenue[hour, kind] += Decimal(str(amount))
    return {
        (hour, kind, n, revenue[hour, kind].quantize(Decimal("0.01")))
        for (hour, kind), n in tally.items()
    }


def revenue_run(spark, folder, target=None, files_per_batch=1000, delay=hourly.DELAY):
    table = stream_table(spark, folder, "events", files_per_batch)
    return hourly.HourlyRevenue(table, "ts", "amount", "kind", target, delay).run()


def run(spark, folder, target=None, files_per_batch=1000):
    found = revenue_run(spark, folder, target, files_per_batch).totals()
    return [tuple(row) for row in found.collect()]


def test_all_hours_at_hand(spark, tmp_path):
    rows = made(0, 90)
    write(spark, tmp_path, [*rows, (99, None, "a", 5.0)])
    found = run(spark, str(tmp_path))
    assert set(found) == hours_of(rows)
    assert len(found) == len(set(found))


def test_parts_of_cents(spark, tmp_path):
    write(spark, tmp_path, [(i, START, "a", 0.004) for i in range(1000)])
    assert run(spark, str(tmp_path)) == [(START, "a", 1000, Decimal("4.00"))]


def test_a_second_run_goes_on_from_the_first(spark, tmp_path):
    target = shared_folder(spark, "stream")
    write(spark, tmp_path, made(0, 50))
    assert set(run(spark, str(tmp_path), target)) == hours_of(made(0, 50))
    write(spark, tmp_path, made(50, 120))
    both = run(spark, str(tmp_path), target)
    assert set(both) == hours_of(made(0, 120)) and len(both) == len(set(both))
    # Nothing new: nothing changes.
    assert sorted(run(spark, str(tmp_path), target)) == sorted(both)


@pytest.mark.parametrize("order", [[0, 40, 80], [80, 40, 0], [40, 80, 0]])
def test_files_in_any_order_and_small_batches(spark, tmp_path, order):
    """No row is late: newest file first gives the same hours."""
    target = shared_folder(spark, "stream")
    for first in order:
        write(spark, tmp_path, made(first, first + 40))
        run(spark, str(tmp_path), target, files_per_batch=1)
    assert set(run(spark, str(tmp_path), target)) == hours_of(made(0, 120))
    assert set(run(spark, str(tmp_path), files_per_batch=1)) == hours_of(made(0, 120))


def surge_run(spark, folder, factor, files_per_batch=1000, target=None, delay=hourly.DELAY):
    table = stream_table(spark, folder, "events", files_per_batch)
    return hourly.Surges(table, "ts", factor, target, delay).run()


def surges(spark, folder, factor, files_per_batch=1000, target=None):
    found = surge_run(spark, folder, factor, files_per_batch, target).surges()
    return sorted(tuple(row) for row in found.collect())


def days(counts):
    """Rows of one hour of the day, by day."""
    return [
        (0, datetime(2006, 2, 1, 15, i % 60) + timedelta(days=day), "a", 1.0)
        for day, n in counts.items()
        for i in range(n)
    ]


def test_surging_hour(spark, tmp_path):
    """The bar is the mean of earlier weeks; the spike and later weeks don't raise it."""
    write(spark, tmp_path, days({0: 2, 7: 4, 14: 30, 21: 100}))
    assert surges(spark, str(tmp_path), 3.0) == [
        (datetime(2006, 2, 15, 15), 30, 3.0),
        (datetime(2006, 2, 22, 15), 100, 12.0),
    ]


def test_later_rows_do_not_change_a_verdict(spark, tmp_path):
    write(spark, tmp_path, days({0: 2, 7: 4, 14: 30}))
    before = surges(spark, str(tmp_path), 3.0)
    write(spark, tmp_path, days({21: 5, 28: 5}))
    assert surges(spark, str(tmp_path), 3.0, files_per_batch=1) == before
    assert before == [(datetime(2006, 2, 15, 15), 30, 3.0)]


def test_no_row_gives_an_empty_frame(spark, tmp_path):
    write(spark, tmp_path, [(1, None, "a", 1.0)])
    assert run(spark, str(tmp_path)) == []


def test_input_is_read_once(spark, tmp_path):
    """A surge run has no other source than the stream."""
    write(spark, tmp_path, days({0: 2, 7: 4, 14: 30}))
    text = surge_run(spark, str(tmp_path), 3.0).surges()._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in text


def weeks(counts):
    """Hours of one weekday and hour of the day, a file per week."""
    return [days({7 * i: n}) for i, n in enumerate(counts)]


COUNTS = [3, 5, 4, 20, 6, 5, 40, 2, 9]


def test_a_resumed_surge_run_equals_one_run(spark, tmp_path):
    target = shared_folder(spark, "surge")
    for rows in weeks(COUNTS):
        write(spark, tmp_path, rows)
        resumed = surges(spark, str(tmp_path), 1.5, target=target)
    expected, total = [], 0
    for i, n in enumerate(COUNTS):
        if i and n > 1.5 * total / i:
            expected.append((datetime(2006, 2, 1, 15) + timedelta(days=7 * i), n, total / i))
        total += n
    assert resumed == expected
    assert surges(spark, str(tmp_path), 1.5) == expected
    assert surges(spark, str(tmp_path), 1.5, files_per_batch=3) == expected


def test_a_surge_run_looks_at_open_hours_and_slots_only(spark, tmp_path):
    target = shared_folder(spark, "surge")
    for rows in weeks(COUNTS[:6]):
        write(spark, tmp_path, rows)
        found = surge_run(spark, str(tmp_path), 1.5, target=target)
    hours, slots = found.left()
    assert [tuple(r) for r in hours.collect()] == [(datetime(2006, 2, 1, 15) + timedelta(days=35), COUNTS[5])]
    assert [tuple(r) for r in slots.collect()] == [(2, 15, 5, sum(COUNTS[:5]))]
    # What older hours were judged by is not there any more, and is not missed.
    assert sorted(found.carried.numbers()) == [4, 5]


def test_late_rows_count_and_are_told_apart(spark, tmp_path):
    """Newest file first, and hours that close after a day."""
    target = shared_folder(spark, "stream")
    order = [(200, 300), (0, 100), (100, 200)]
    for low, high in order:
        write(spark, tmp_path, made(low, high))
        found = revenue_run(spark, str(tmp_path), target, delay=24)
    assert {tuple(r) for r in found.totals().collect()} == hours_of(made(0, 300))
    # The latest hour is that of row 299; closed are those a day before it.
    closed = (START + timedelta(minutes=15 * 299)).replace(minute=0) - timedelta(hours=24)
    late = [r for r in made(0, 200) if r[1].replace(minute=0, second=0) < closed]
    assert {tuple(r) for r in found.corrections().collect()} == hours_of(late)
    in_order = revenue_run(spark, str(tmp_path), delay=10_000)
    assert in_order.corrections().count() == 0


def test_late_rows_change_no_verdict(spark, tmp_path):
    target = shared_folder(spark, "surge")
    write(spark, tmp_path, days({0: 2, 7: 4, 14: 30}))
    surge_run(spark, str(tmp_path), 3.0, target=target)
    write(spark, tmp_path, days({0: 500, 21: 1}))
    found = surge_run(spark, str(tmp_path), 3.0, target=target)
    assert [tuple(r) for r in found.surges().collect()] == [(datetime(2006, 2, 15, 15), 30, 3.0)]
    assert [tuple(r) for r in found.corrections().collect()] == [(datetime(2006, 2, 1, 15), 500)]


def test_folders_stay_few_and_no_state_is_kept(spark, tmp_path, monkeypatch):
    """Three folders make one of the next tier; Spark's own state is not used."""
    monkeypatch.setattr(tables, "FAN", 3)
    target = shared_folder(spark, "stream")
    seen = []
    for i in range(10):
        write(spark, tmp_path, made(10 * i, 10 * i + 10))
        found = revenue_run(spark, str(tmp_path), target)
        seen.append(sorted(found.sums.live()))
        assert sorted(tables.complete_folders(spark, f"{target}/hours")) == sorted(f"part-{t}-{n}" for t, n in seen[-1])
    assert seen[4:] == [[(0, 3), (0, 4), (1, 2)], [(1, 2), (1, 5)], [(0, 6), (1, 2), (1, 5)],
                        [(0, 6), (0, 7), (1, 2), (1, 5)], [(2, 8)], [(0, 9), (2, 8)]]
    assert {tuple(r) for r in found.totals().collect()} == hours_of(made(0, 100))
    offsets = (pathlib.Path(target.removeprefix("file://")) / "progress")
    assert (offsets / "commits").is_dir() and not (offsets / "state").exists()


def test_a_batch_that_is_run_again(spark, tmp_path, monkeypatch):
    """After a break anywhere, the same numbers: parts are replaced or known to be in."""
    monkeypatch.setattr(tables, "FAN", 2)
    schema = "k STRING, n LONG"
    sums = tables.Sums(spark, shared_folder(spark, "sums"), spark.createDataFrame([], schema).schema, ("k",))
    for number in range(4):
        for _ in range(2):
            sums.add(spark.createDataFrame([("a", 1), ("a", 1), ("b", number)], schema), number)
    assert sorted(sums.live()) == [(2, 3)]
    # Folders that a break left beside the one they were summed into.
    spark.createDataFrame([("a", 99)], schema).write.parquet(f"{sums.folder}/part-0-3")
    spark.createDataFrame([("a", 99)], schema).write.parquet(f"{sums.folder}/part-1-1")
    assert {tuple(r) for r in sums.table().collect()} == {("a", 8), ("b", 6)}
    sums.add(spark.createDataFrame([("b", 10)], schema), 4)
    assert {tuple(r) for r in sums.table().collect()} == {("a", 8), ("b", 16)}
    assert sorted(tables.complete_folders(spark, sums.folder)) == ["part-0-4", "part-2-3"]


@pytest.mark.parametrize(
    "master", ["spark://far:7077", "yarn", "local-cluster[3,2,3000]"]
)
def test_a_cluster_needs_a_shared_folder(master):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        pass

    class Session:
        conf = Conf()
        sparkContext = Context()

    Session.sparkContext.master = master
    with pytest.raises(ValueError):
        shared_folder(Session(), "x")
    Conf.get = lambda self, name, default: "/tmp/x"
    with pytest.raises(ValueError):
        shared_folder(Session(), "x")
    Conf.get = lambda self, name, default: "hdfs://far/x"
    assert shared_folder(Session(), "x").startswith("hdfs://far/x/x-")


def test_state_store_of_the_cluster_settings(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    write(spark, tmp_path, made(0, 90))
    spark.conf.set(name, CLUSTER_SETTINGS[name])
    try:
        found = run(spark, str(tmp_path))
    finally:
        spark.conf.set(name, before)
    assert set(found) == hours_of(made(0, 90))
