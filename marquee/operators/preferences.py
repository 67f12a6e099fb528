"""Favourite category per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marquee.operators.skew import spread_join
from marquee.session import written


def rented_genres(
    rental: DataFrame,
    inventory: DataFrame,
    film: DataFrame,
    film_category: DataFrame,
    category: DataFrame,
    spread: bool = False,
) -> DataFrame:
    """Rentals with a genre name, over the four catalogue tables.

    The catalogue is joined first, films with their genres and then items with
    theirs, and each result is written, so that its size is known: Spark broadcasts
    it if that is small. If not, the rentals are shuffled once, by their item, and
    AQE can split an item, as both sides of the join are plain tables; a film that
    holds a third of the rentals is spread over its items. With ``spread``, hot items
    are found beforehand and dealt over several tasks, whatever AQE makes of them.
    """
    genres = (
        film.select("film_id")
        .join(film_category.select("film_id", "category_id"), "film_id")
        .join(category.selectExpr("category_id", "name AS genre"), "category_id")
        .select("film_id", "genre")
    )
    items = inventory.select("inventory_id", "film_id").join(
        written(genres, "film-genres"), "film_id"
    )
    items = written(items.select("inventory_id", "genre"), "item-genres")
    facts = rental.select("customer_id", "rental_id", "inventory_id")
    join = spread_join if spread else DataFrame.join
    return join(facts, items, "inventory_id").select("customer_id", "rental_id", "genre")


def top_category_per_customer(customer: DataFrame, rented: DataFrame) -> DataFrame:
    """The most rented genre of every customer who rented, equal counts by name.

    ``rented`` has ``customer_id``, ``rental_id`` and ``genre``. Rentals are
    counted per customer and genre in the map tasks, so a customer with very many
    rentals becomes a few rows before anything is grouped by customer. Names are
    joined to the one row left per customer. Where ``genre`` ignores case, the spelling
    shown is the first by bytes of those that were counted together.
    """
    spelling = F.min(F.collate(F.col("genre"), "UTF8_BINARY")).alias("spelling")
    cased = rented.schema["genre"].dataType == StringType()
    counts = (
        rented.where("customer_id IS NOT NULL")
        .groupBy("customer_id", "genre")
        .agg(F.count("rental_id").alias("rental_count"), *([] if cased else [spelling]))
    )
    ranking = Window.partitionBy("customer_id").orderBy(F.desc("rental_count"), "genre")
    favourites = counts.withColumn("rn", F.row_number().over(ranking)).where("rn = 1")
    return (
        favourites.join(
            customer.select("customer_id", "first_name", "last_name"), "customer_id"
        )
        .selectExpr(
            "customer_id",
            "first_name",
            "last_name",
            f"{'genre' if cased else 'spelling'} AS preferred_genre",
            "rental_count",
        )
        .orderBy("customer_id")
    )
