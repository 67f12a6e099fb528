"""Tables whose files hold different columns."""

from __future__ import annotations

import itertools
import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from marquee.sources import evolving, read_table, stream_table

GENERATIONS = [
    ("a INT, day DATE, price DECIMAL(6,2), s STRUCT<x: INT>", [(1, date(2005, 7, 1), Decimal("1.25"), (1,))]),
    ("a INT, b STRING, day DATE", [(2, "two", date(2005, 7, 2))]),
    (
        "b STRING, a BIGINT, day TIMESTAMP_NTZ, price DECIMAL(9,3), s STRUCT<x: BIGINT, y: STRING>, f ARRAY<FLOAT>",
        [("three", 3 << 33, datetime(2005, 7, 3, 4), Decimal("123456.125"), (4 << 33, "y"), [0.5])],
    ),
    ("a SMALLINT, f ARRAY<DOUBLE>, only DOUBLE", [(4, [0.1, None], 1.5)]),
]
WHOLE = {
    "a": "bigint", "b": "string", "day": "timestamp_ntz", "price": "decimal(9,3)",
    "s": "struct<x:bigint,y:string>", "f": "array<double>", "only": "double",
}
ROWS = {
    (1, None, datetime(2005, 7, 1), Decimal("1.250"), (1, None), None, None),
    (2, "two", datetime(2005, 7, 2), None, None, None, None),
    (3 << 33, "three", datetime(2005, 7, 3, 4), Decimal("123456.125"), (4 << 33, "y"), (0.5,), None),
    (4, None, None, None, None, (0.1, None), 1.5),
}


def add(spark, folder, generation, fmt="parquet", table="t"):
    schema, rows = generation
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    frame.write.mode("append").format(fmt).save(f"{folder}/{table}.{fmt}")


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def rows_of(frame):
    return {plain(tuple(row)) for row in frame.select(*WHOLE).collect()}


@pytest.mark.parametrize("order", list(itertools.permutations(range(4), 4))[::9])
def test_files_in_any_order(spark, tmp_path, order):
    for i in order:
        add(spark, tmp_path, GENERATIONS[i])
    table = read_table(spark, str(tmp_path), "t")
    assert dict(table.dtypes) == WHOLE
    assert rows_of(table) == ROWS


def test_added_columns_as_orc(spark, tmp_path):
    add(spark, tmp_path, ("a INT", [(1,)]), "orc")
    add(spark, tmp_path, ("a BIGINT, b STRING", [(1 << 40, "x")]), "orc")
    table = read_table(spark, str(tmp_path), "t", "orc")
    assert dict(table.dtypes) == {"a": "bigint", "b": "string"}
    assert {tuple(r) for r in table.select("a", "b").collect()} == {(1, None), (1 << 40, "x")}


def test_stream_of_all_columns(spark, tmp_path):
    for generation in GENERATIONS:
        add(spark, tmp_path, generation)
    stream = stream_table(spark, str(tmp_path), "t", files_per_batch=1)
    query = (
        stream.writeStream.format("memory").queryName("evolved")
        .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows_of(spark.table("evolved")) == ROWS


def test_filters_and_columns_still_reach_the_scan(spark, tmp_path):
    for generation in GENERATIONS:
        add(spark, tmp_path, generation)
    table = read_table(spark, str(tmp_path), "t").where("a > 3").select("b")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,3)]" in plan
    assert re.search(r"ReadSchema: struct<(a:bigint,b:string|b:string,a:bigint)>", plan)
    assert table.count() == 2


@pytest.mark.parametrize(
    ("one", "two"),
    [("a INT", "a STRING"), ("a BIGINT", "a DOUBLE"), ("a TIMESTAMP", "a TIMESTAMP_NTZ"), ("a BOOLEAN", "a INT"),
     ("a DECIMAL(38,0)", "a DECIMAL(38,10)"), ("s STRUCT<x: INT>", "s STRUCT<x: STRING>"), ("a ARRAY<INT>", "a INT")],
)
def test_types_without_a_common_one(spark, tmp_path, one, two):
    for schema in (one, two):
        add(spark, tmp_path, (schema, [(None,)]))
    with pytest.raises(ValueError, match="files hold (a|s.x)"):
        read_table(spark, str(tmp_path), "t")


def test_folder_names_as_columns(spark, tmp_path):
    add(spark, tmp_path, ("a INT", [(1,)]), table="t.parquet/month=2005-07/part")
    add(spark, tmp_path, ("a BIGINT, b STRING", [(2, "x")]), table="t.parquet/month=2005-08/part")
    table = read_table(spark, str(tmp_path), "t")
    assert table.columns == ["a", "b", "month"]
    assert {tuple(r) for r in table.collect()} == {(1, None, date(2005, 7, 1)), (2, "x", date(2005, 8, 1))} or {
        tuple(r) for r in table.collect()
    } == {(1, None, "2005-07"), (2, "x", "2005-08")}


def test_names_that_differ_in_case(spark, tmp_path):
    add(spark, tmp_path, ("Name STRING", [("x",)]))
    add(spark, tmp_path, ("name STRING, n INT", [("y", 1)]))
    table = read_table(spark, str(tmp_path), "t")
    assert [c.lower() for c in sorted(table.columns)] == ["name", "n"] or len(table.columns) == 2
    assert {r[0] for r in table.select("name").collect()} == {"x", "y"}


def test_ledger_reads_new_footers_only(spark, tmp_path, monkeypatch):
    folder, ledger = str(tmp_path), f"{tmp_path}/ledger"
    looked_at = []
    footers = evolving.footers

    def watched(session, fmt, paths):
        looked_at.append(len(paths))
        return footers(session, fmt, paths)

    monkeypatch.setattr(evolving, "footers", watched)

    def columns():
        looked_at.clear()
        return dict(read_table(spark, folder, "t", ledger=ledger).dtypes)

    add(spark, folder, ("a INT", [(1,)]))
    add(spark, folder, ("a INT", [(1,)]))
    assert columns() == {"a": "int"} and looked_at == [2]
    assert columns() == {"a": "int"} and looked_at == []
    add(spark, folder, ("a BIGINT, b STRING", [(1, "x")]))
    assert columns() == {"a": "bigint", "b": "string"} and looked_at == [1]
    assert columns() == {"a": "bigint", "b": "string"} and looked_at == []
    # Files that have gone take their columns with them.
    spark.createDataFrame([(1.5,)], "c DOUBLE").write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert columns() == {"c": "double"} and len(looked_at) == 1


def test_an_entry_that_was_broken_off_does_not_count(spark, tmp_path):
    folder, ledger = str(tmp_path), f"{tmp_path}/ledger"
    add(spark, folder, ("a INT", [(1,)]))
    read_table(spark, folder, "t", ledger=ledger)
    spark.createDataFrame([(1,)], "junk INT").write.parquet(f"{ledger}/entry=9")
    (tmp_path / "ledger/entry=9/_SUCCESS").unlink()
    assert read_table(spark, folder, "t", ledger=ledger).columns == ["a"]


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        read_table(spark, str(tmp_path), "nowhere")
    with pytest.raises(PySparkException):
        (tmp_path / "t.parquet").mkdir()
        read_table(spark, str(tmp_path), "t")
