"""An hour cube that follows its table."""

from __future__ import annotations

import pathlib
from collections import Counter
from datetime import datetime, timedelta

import pytest
from handmade import RENTAL, random_rentals

from marquee.operators import counts
from marquee.plans import run_report
from marquee.plans.kept_cube import KeptCube
from marquee.plans.store_queries import FROM_CUBE


def add(spark, folder, rows, mode="append"):
    frame = spark.createDataFrame(rows, RENTAL).coalesce(1)
    frame.write.mode(mode).parquet(f"{folder}/rental.parquet")


def in_month(month, size, first=0):
    start = datetime(2005, month, 1)
    return [(first + i, start + timedelta(hours=7 * i % 600), None, 1, 1) for i in range(size)]


def months_on_disk(folder):
    """When each month's rows were written, by folder."""
    place = pathlib.Path(folder) / "cube"
    return {f"{p.parent.name}/{p.name}": f.stat().st_mtime_ns for p in place.glob("*/month=*") for f in p.glob("part-*")}


def tally(cube):
    return {r.rental_date: (r.row_count, r.id_count) for r in cube.frame.collect()}


def expected(rows):
    hour = [t and t.replace(minute=0, second=0) for _, t, *_ in rows]
    ids = Counter(h for h, row in zip(hour, rows, strict=True) if row[0] is not None)
    return {h: (n, ids[h]) for h, n in Counter(hour).items()}


def test_an_added_file_rewrites_its_months_only(spark, tmp_path):
    kept = KeptCube(spark, f"{tmp_path}/kept")
    first = [*in_month(5, 50), *in_month(6, 40, 100), *in_month(7, 30, 200)]
    add(spark, tmp_path, first)
    assert tally(kept.update(str(tmp_path), "rental")) == expected(first)
    before = months_on_disk(kept.folder)
    assert len(before) == 3

    more = [*in_month(7, 10, 300), *in_month(8, 5, 400), (None, datetime(2005, 8, 2, 3), None, 1, 1)]
    add(spark, tmp_path, more)
    assert tally(kept.update(str(tmp_path), "rental")) == expected(first + more)
    after = months_on_disk(kept.folder)
    assert {k: v for k, v in after.items() if k in before} == before
    assert set(after) - set(before) == {"update-1/month=2005-07", "update-1/month=2005-08"}
    assert kept.homes(1) == {"2005-05": 0, "2005-06": 0, "2005-07": 1, "2005-08": 1}

    # Nothing new, nothing written.
    assert tally(kept.update(str(tmp_path), "rental")) == expected(first + more)
    assert months_on_disk(kept.folder) == after and kept.last() == 1


def test_only_new_files_are_read(spark, tmp_path):
    """Names of files that the entry before has not."""
    kept = KeptCube(spark, f"{tmp_path}/kept")
    first, more = in_month(5, 50), in_month(5, 9, 60)
    add(spark, tmp_path, first)
    kept.update(str(tmp_path), "rental")
    add(spark, tmp_path, more)
    seen = spark.read.parquet(f"{kept.folder}/files/entry-0").collect()
    names = kept.new_files(f"{tmp_path}/rental.parquet", 0)[1]
    assert len(seen) == 1 and len(names) == 1 and seen[0]["path"] not in names
    assert tally(kept.update(str(tmp_path), "rental")) == expected(first + more)


def test_a_file_that_has_gone(spark, tmp_path):
    kept = KeptCube(spark, f"{tmp_path}/kept")
    add(spark, tmp_path, [*in_month(5, 50), *in_month(6, 5)])
    kept.update(str(tmp_path), "rental")
    add(spark, tmp_path, in_month(6, 7), "overwrite")
    assert tally(kept.update(str(tmp_path), "rental")) == expected(in_month(6, 7))
    assert kept.homes(kept.last()) == {"2005-06": 1}


def test_an_update_that_broke_off(spark, tmp_path):
    """Months written without a ledger entry do not count, and are written again."""
    kept = KeptCube(spark, f"{tmp_path}/kept")
    first, more = in_month(5, 50), in_month(5, 9, 60)
    add(spark, tmp_path, first)
    kept.update(str(tmp_path), "rental")
    add(spark, tmp_path, more)
    kept.update(str(tmp_path), "rental")
    (pathlib.Path(kept.folder) / "months/entry-1/_SUCCESS").unlink()
    assert kept.last() == 0 and tally(kept.cube()) == expected(first)
    assert tally(kept.update(str(tmp_path), "rental")) == expected(first + more)


def test_old_folders_go(spark, tmp_path):
    kept = KeptCube(spark, f"{tmp_path}/kept")
    rows = []
    for i in range(4):
        rows += in_month(5, 10, 10 * i)
        add(spark, tmp_path, in_month(5, 10, 10 * i))
        kept.update(str(tmp_path), "rental")
    assert tally(kept.cube()) == expected(rows)
    place = pathlib.Path(kept.folder)
    assert sorted(p.name for p in (place / "cube").iterdir()) == ["update-2", "update-3"]
    assert len(list((place / "files").iterdir())) == len(list((place / "months").iterdir())) == 2


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("kept")
    rows = [*random_rentals(seed=3, size=300), (None, None, None, 1, 1)]
    kept = KeptCube(spark, f"{folder}/kept")
    for part in (rows[:100], rows[100:]):
        add(spark, folder, part)
        kept.update(str(folder), "rental")
    return kept.cube(), spark.createDataFrame(rows, RENTAL).cache()


@pytest.mark.parametrize("name", FROM_CUBE[::3])
def test_same_report(both, name):
    cube, rental = both
    assert run_report(name, {"rental": cube}).collect() == run_report(name, {"rental": rental}).collect()


def test_an_empty_table(spark, tmp_path):
    kept = KeptCube(spark, f"{tmp_path}/kept")
    assert kept.cube().frame.count() == 0
    add(spark, tmp_path, [])
    assert kept.update(str(tmp_path), "rental").frame.count() == 0
    add(spark, tmp_path, in_month(5, 3))
    assert counts.hourly_counts(kept.update(str(tmp_path), "rental")).count() == 3
