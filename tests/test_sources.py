from __future__ import annotations

import pytest
from handmade import RENTAL, random_rentals

from marquee import session, sources


@pytest.fixture(scope="module")
def rental(spark):
    return spark.createDataFrame(random_rentals(seed=8, size=50), RENTAL)


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_tables_as_files(spark, rental, tmp_path, fmt):
    rental.write.format(fmt).save(f"{tmp_path}/rental.{fmt}")
    again = sources.read_table(spark, str(tmp_path), "rental", fmt)
    assert again.schema == rental.schema
    assert sorted(map(tuple, again.collect()), key=str) == sorted(
        map(tuple, rental.collect()), key=str
    )


def test_changed_columns_show(spark, rental, tmp_path):
    """A column added and one renamed, for tables and streams alike."""

    def columns():
        table = sources.read_table(spark, str(tmp_path), "rental")
        stream = sources.stream_table(spark, str(tmp_path), "rental")
        assert stream.columns == table.columns
        return table

    rental.select("rental_id").write.parquet(f"{tmp_path}/rental.parquet")
    assert columns().columns == ["rental_id"]
    rental.write.mode("overwrite").parquet(f"{tmp_path}/rental.parquet")
    assert columns().columns == rental.columns
    renamed = rental.withColumnRenamed("rental_id", "number")
    renamed.write.mode("overwrite").parquet(f"{tmp_path}/rental.parquet")
    again = columns()
    assert again.columns == renamed.columns
    assert again.where("number IS NOT NULL").count() == 50


def test_own_schema(spark, rental, tmp_path):
    rental.write.parquet(f"{tmp_path}/rental.parquet")
    schema = rental.select("rental_id").schema
    table = sources.read_table(spark, str(tmp_path), "rental", schema=schema)
    assert table.schema == schema
    assert sources.stream_table(spark, str(tmp_path), "rental", schema=schema).columns == [
        "rental_id"
    ]


@pytest.mark.parametrize("fmt", ["csv", "json", "text"])
def test_formats_without_a_schema_are_refused(spark, tmp_path, fmt):
    with pytest.raises(ValueError):
        sources.read_table(spark, str(tmp_path), "rental", fmt)


def test_one_connection_only_on_request(spark):
    with pytest.raises(ValueError):
        sources.jdbc_table(spark, {"url": "jdbc:none"}, "payment")


def test_sql_text_over_views(spark, rental):
    sources.register_views(spark, {"rental": rental})
    found = sources.run_sql(
        spark,
        "SELECT r.hour_of_day AS `시각`, count(*) AS `횟수` "
        "FROM (SELECT hour(rental_date) AS hour_of_day FROM rental) r "
        "GROUP BY `시각` ORDER BY `시각`",
    )
    assert found.columns == ["시각", "횟수"]
    assert sum(row[1] for row in found.collect()) == 50


def test_sql_text_over_frames(spark, rental):
    text = "SELECT count(*) AS n FROM {facts}"
    assert sources.run_sql(spark, text, {"facts": rental}).first().n == 50


def test_databases_and_their_tables(spark, rental):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    try:
        rental.write.mode("overwrite").saveAsTable("shop.rental_saved")
        sources.use_database(spark, "shop")
        sources.register_views(spark, {"actor_view": rental})
        names = [row.table_name for row in sources.list_tables(spark).collect()]
        assert {"rental_saved", "actor_view"} <= set(names)
        assert names == sorted(names)
        only = sources.list_tables(spark, "rental_s*").collect()
        assert [row.table_name for row in only] == ["rental_saved"]
        assert spark.table("rental_saved").count() == 50
    finally:
        sources.use_database(spark, "default")
        spark.sql("DROP DATABASE shop CASCADE")


def test_connection_needs_a_password():
    with pytest.raises(KeyError):
        sources.connection_from_env("shop", {})
    found = sources.connection_from_env(
        "shop", {"MYSQL_PASSWORD": "x", "MYSQL_HOST": "db"}
    )
    assert found == {
        "url": "jdbc:mysql://db:3306/shop?useCursorFetch=true",
        "user": "root",
        "password": "x",
    }


def test_range_read_options():
    connection = {"url": "jdbc:mysql://db:3306/shop"}
    options = sources.jdbc_options(connection, "payment", "payment_id", (1, 16049), 8)
    assert options == {
        "url": "jdbc:mysql://db:3306/shop",
        "dbtable": "payment",
        "fetchsize": "10000",
        "preferTimestampNTZ": "true",
        "partitionColumn": "payment_id",
        "lowerBound": "1",
        "upperBound": "16049",
        "numPartitions": "8",
    }
    assert "numPartitions" not in sources.jdbc_options(connection, "store")
    with pytest.raises(ValueError):
        sources.jdbc_options(connection, "payment", "payment_id")


def test_shared_folder_lies_below_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first = session.shared_folder(spark, "x")
    assert first.startswith(f"{root}/x-")
    assert first != session.shared_folder(spark, "x")


@pytest.mark.parametrize("checkpoints", [None, "/shared/checkpoints"])
def test_a_cluster_shares_its_warehouse(checkpoints):
    settings = {"spark.checkpoint.dir": checkpoints, "spark.sql.warehouse.dir": "hdfs://far/tables"}

    class Session:
        conf = settings
        sparkContext = type("Context", (), {"master": "local-cluster[3,4,10000]"})

    assert session.shared_folder(Session(), "x").startswith("hdfs://far/tables/x-")
    settings["spark.checkpoint.dir"] = "hdfs://far/checkpoints"
    assert session.shared_folder(Session(), "x").startswith("hdfs://far/checkpoints/x-")
    settings |= {"spark.checkpoint.dir": checkpoints, "spark.sql.warehouse.dir": None}
    with pytest.raises(ValueError):
        session.shared_folder(Session(), "x")
