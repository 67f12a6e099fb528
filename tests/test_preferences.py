from __future__ import annotations

import random
from collections import Counter

import pytest
from handmade import rentals
from pyspark.sql import functions as F

from marquee.operators import preferences


@pytest.fixture(scope="module")
def catalogue(spark):
    """Six items; film 13 lacks a film row, film 12 is in two categories."""
    return {
        "inventory": spark.createDataFrame(
            [(1, 11), (2, 11), (3, 12), (4, 13), (5, 14), (6, 15)],
            "inventory_id BIGINT, film_id BIGINT",
        ),
        "film": spark.createDataFrame([(11,), (12,), (14,), (15,)], "film_id BIGINT"),
        "film_category": spark.createDataFrame(
            [(11, 1), (12, 2), (12, 3), (13, 1), (14, 3), (15, 4)],
            "film_id BIGINT, category_id BIGINT",
        ),
        "category": spark.createDataFrame(
            [(1, "Action"), (2, "Drama"), (3, "Comedy")],
            "category_id BIGINT, name STRING",
        ),
    }


GENRES = {1: ["Action"], 2: ["Action"], 3: ["Drama", "Comedy"], 5: ["Comedy"]}


@pytest.fixture(scope="module")
def customer(spark):
    rows = [(1, "MARY", "SMITH"), (2, "PATRICIA", "JOHNSON"), (3, "LINDA", "WILLIAMS")]
    schema = "customer_id BIGINT, first_name STRING, last_name STRING"
    return spark.createDataFrame(rows, schema)


def favourites(customer, rental, catalogue):
    rented = preferences.rented_genres(rental, **catalogue)
    found = preferences.top_category_per_customer(customer, rented)
    return [tuple(row) for row in found.collect()]


def rented(spark, pairs):
    when = "2005-05-24T10:00"
    return rentals(
        spark, [(i, when, None, who, what) for i, (who, what) in enumerate(pairs)]
    )


def test_most_rented_genre(spark, customer, catalogue):
    rental = rented(spark, [(1, 1), (1, 2), (1, 5), (2, 4), (2, 5), (9, 1), (None, 1)])
    assert favourites(customer, rental, catalogue) == [
        (1, "MARY", "SMITH", "Action", 2),
        (2, "PATRICIA", "JOHNSON", "Comedy", 1),
    ]


def test_equal_genres_by_name(spark, customer, catalogue):
    assert favourites(customer, rented(spark, [(3, 3), (3, 1)]), catalogue) == [
        (3, "LINDA", "WILLIAMS", "Action", 1)
    ]


def test_category_names_tell_genres_apart_by_case(spark, customer):
    genres = spark.createDataFrame(
        [(1, 1, "drama"), (1, 2, "Drama"), (1, 3, "drama")],
        "customer_id BIGINT, rental_id BIGINT, genre STRING",
    )
    found = preferences.top_category_per_customer(customer, genres).collect()
    assert [tuple(row)[3:] for row in found] == [("drama", 2)]


def test_category_names_without_case_by_collation(spark, customer):
    genres = spark.createDataFrame(
        [(1, 1, "drama"), (1, 2, "Drama"), (1, 3, "Action"), (1, 4, "DRAMA")],
        "customer_id BIGINT, rental_id BIGINT, genre STRING",
    ).withColumn("genre", F.collate("genre", "UTF8_LCASE"))
    found = preferences.top_category_per_customer(customer, genres).collect()
    assert [(row[3].lower(), row[4]) for row in found] == [("drama", 3)]


def test_one_customer_with_a_third_of_all_rentals(spark, customer, catalogue):
    pick = random.Random(3)
    pairs = [
        (1 if i % 3 == 0 else pick.choice([2, 3, 4, None]), pick.randrange(1, 7))
        for i in range(5000)
    ]
    tally = Counter(
        (who, genre) for who, what in pairs for genre in GENRES.get(what, [])
    )
    expected = []
    for who in (1, 2, 3):
        best = min((-n, genre) for (other, genre), n in tally.items() if other == who)
        expected.append((who, best[1], -best[0]))
    found = favourites(customer, rented(spark, pairs), catalogue)
    assert [(row[0], row[3], row[4]) for row in found] == expected
