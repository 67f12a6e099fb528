"""Quality rules: fixed bounds, and outliers by a robust covariance per language and source.

The covariance is the minimum-covariance-determinant estimate: of all subsets
with half of a cell's documents, the one whose covariance has the smallest
determinant. It is searched as in FAST-MCD by concentration steps (keep the half
that is nearest to the present centre, estimate again), from two starts. A step is
one aggregation: documents are counted and summed in classes of distance, so a
cell of any size is some hundred rows after the map side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.llm.common import Tables, by_arrow, long_fields, with_columns, written
from marquee.llm.text_stats import text_stats

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
DIMS = 5
# Spread added to each coordinate (as a standard deviation): most documents of a
# cell may have no symbols, repeated lines or windows at all, and a covariance of
# zero would make an outlier of any other document. In order of the coordinates:
# log of the words, log of letters a word, roots of the three shares. In a cell without
# any repetition, a share of 0.38 of duplicate lines or repeated windows, or of 0.27
# symbols a word, is past the cut-off by itself.
FLOOR = (0.3, 0.05, 0.1, 0.12, 0.12)
# A cell with fewer documents is joined with the other small ones of its language.
LEAST = 50
STEPS = 6
# Share of well-behaved documents that the cut-off would reject.
REJECTED = 1e-4
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def chi_square(p: float, dims: int = DIMS) -> float:
    """Quantile of the chi-square distribution (Wilson-Hilferty)."""
    part = 2 / (9 * dims)
    return dims * (1 - part + NormalDist().inv_cdf(p) * math.sqrt(part)) ** 3


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """The documents with the counts of ``text_stats``, names led by ``prefix``."""
    names = [prefix + s for s in STATS]

    def make(texts: list[str]) -> list:
        stats = text_stats(texts)
        return [stats[s] for s in STATS]

    return with_columns(docs, text, StructType(long_fields(*names)), make)


def base_failed(prefix: str = "", least_words: int = 50, most_repeated: int = 50) -> Column:
    """Too few words, or too large a share (in percent) in repeated windows."""
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < least_words) | (100 * repeated > most_repeated * words)


def coordinates(prefix: str = "") -> list[Column]:
    """The transformed counts; a document without words is at the origin."""
    c = {s: F.col(prefix + s).cast("double") for s in STATS}

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.sqrt(F.try_divide(part, whole)), F.lit(0.0))

    return [
        F.log(F.greatest(c["n_words"], F.lit(1.0))),
        F.coalesce(F.log(F.try_divide(c["word_chars"], c["n_words"])), F.lit(0.0)),
        share(c["n_symbols"], c["n_words"]),
        share(c["n_dup_lines"], c["n_lines"]),
        share(c["n_repeat_words"], c["n_words"]),
    ]


def cell_of(lang: str, source: str) -> tuple[Column, Column]:
    """Names of a document's cell and of its language; null is a value of its own."""
    lang_name = F.coalesce(F.concat(F.lit("="), F.col(f"`{lang}`").cast("string")), F.lit("-"))
    source_name = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-"))
    return F.to_json(F.array(lang_name, source_name)), F.to_json(F.array(lang_name))


def distance(x: list[str]) -> Column:
    """Squared Mahalanobis distance to ``centre`` with the inverse covariance ``inverse``."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        term = (F.col(x[i]) - F.col("centre")[i]) * (F.col(x[j]) - F.col("centre")[j])
        total = total + term * F.col("inverse")[i * DIMS + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


X = [f"x{i}" for i in range(DIMS)]
MODEL = "cell string, start int, n long, centre array<double>, inverse array<double>, logdet double, scale double"


def model_from_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre and inverse covariance from counts and sums (one row a cell and start)."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            centre = np.array([r[f"s{i}"] for i in range(DIMS)]) / r["count"]
            cov = np.empty((DIMS, DIMS))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = r[f"s{i}{j}"] / r["count"] - centre[i] * centre[j]
            cov = cov * r["scale"] + np.diag(np.square(FLOOR))
            inverse = np.linalg.inv(cov)
            rows.append(
                {
                    "cell": r["cell"],
                    "start": r["start"],
                    "n": r["n"],
                    # Sums depend on their order in the last digits; verdicts should not.
                    "centre": [float(f"{v:.9g}") for v in centre],
                    "inverse": [float(f"{v:.9g}") for v in inverse.ravel()],
                    "logdet": float(f"{np.linalg.slogdet(cov)[1]:.9g}"),
                    "scale": r["edge"],
                }
            )
        if rows:
            kind = pa.struct(
                [("cell", pa.string()), ("start", pa.int32()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())),
                 ("inverse", pa.list_(pa.float64())), ("logdet", pa.float64()), ("scale", pa.float64())]
            )
            yield pa.RecordBatch.from_struct_array(pa.array(rows, type=kind))


def sums() -> list[Column]:
    return [
        F.count("*").alias("count"),
        *[F.sum(X[i]).alias(f"s{i}") for i in range(DIMS)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS],
    ]


def concentrated(points: DataFrame, model: DataFrame, least: Column, tables: Tables) -> DataFrame:
    """A concentration step: the model from the ``least`` nearest documents of each cell."""
    # Classes of distance: 32 to a doubling.
    distance_class = F.floor(F.log2(distance(X) + F.lit(1e-6)) * 32)
    near = points.join(model, "cell").withColumn("class", distance_class)
    classes = near.groupBy("cell", "start", "class").agg(F.first("n").alias("n"), *sums())
    names = ["count", *[f"s{i}" for i in range(DIMS)], *[f"s{i}{j}" for i, j in PAIRS]]
    upto = Window.partitionBy("cell", "start").orderBy("class")
    running = classes.select(
        "cell", "start", "n", "class", F.col("count").alias("own"),
        *[F.sum(c).over(upto).alias(c) for c in names],
    )
    enough = running.where((F.col("count") >= least) & (F.col("count") - F.col("own") < least))
    edge = F.pow(F.lit(2.0), (F.col("class") + 1) / 32)
    enough = enough.withColumn("edge", edge).withColumn("scale", F.lit(1.0))
    return tables.written(enough.transform(by_arrow(model_from_sums, MODEL)), "mcd")


def fit(points: DataFrame) -> DataFrame:
    """``centre`` and ``inverse`` of every cell of ``points`` (``cell``, ``x0`` to ``x4``)."""
    tables = Tables()
    whole = points.groupBy("cell").agg(
        *sums(),
        *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"quarters{i}") for i, x in enumerate(X)],
    )
    whole = tables.written(whole, "mcd").withColumn("n", F.col("count"))
    whole = whole.withColumn("edge", F.lit(0.0)).withColumn("scale", F.lit(1.0))
    # One start is the plain covariance, one the medians and quartile ranges.
    count = F.col("count").cast("double")
    median = [F.col(f"quarters{i}")[1] for i in range(DIMS)]
    spread = [(F.col(f"quarters{i}")[2] - F.col(f"quarters{i}")[0]) / 1.349 for i in range(DIMS)]
    variance = {(i, j): spread[i] * spread[i] if i == j else F.lit(0.0) for i, j in PAIRS}
    robust = whole.select(
        "cell", "n", "edge", "scale", "count",
        *[(median[i] * count).alias(f"s{i}") for i in range(DIMS)],
        *[(count * (median[i] * median[j] + variance[i, j])).alias(f"s{i}{j}") for i, j in PAIRS],
    )
    columns = robust.columns
    starts = whole.select(*columns).withColumn("start", F.lit(0)).unionByName(robust.withColumn("start", F.lit(1)))
    model = tables.written(starts.transform(by_arrow(model_from_sums, MODEL)), "mcd")
    half = F.floor((F.col("n") + DIMS + 1) / 2)
    for _ in range(STEPS):
        model = concentrated(points, model, half, tables)
    best = Window.partitionBy("cell").orderBy("logdet", "start")
    model = model.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    # The half's covariance is too small for all; then all near documents count.
    factor = F.greatest(F.col("scale") / chi_square(0.5), F.lit(1.0))
    near = points.join(model, "cell").withColumn("d2", distance(X) / factor)
    near = near.where(F.col("d2") <= chi_square(0.975))
    final = near.groupBy("cell").agg(F.first("n").alias("n"), *sums())
    final = final.withColumn("start", F.lit(0)).withColumn("edge", F.lit(1.0)).withColumn("scale", F.lit(1.0))
    final = final.transform(by_arrow(model_from_sums, MODEL))
    final = written(final.select("cell", "centre", "inverse"), "mcd")
    tables.delete()
    return final


def cells(points: DataFrame) -> DataFrame:
    """Cell and language of the points (``own_cell``, ``own_lang``) with the cell that
    they are judged in: their own, the small ones of their language, all small ones,
    or none (null) if even those are fewer than ``LEAST``."""
    own = written(points.groupBy("own_cell", "own_lang").agg(F.count("*").alias("n")), "cells")
    pools = own.where(F.col("n") < LEAST).groupBy("own_lang").agg(F.sum("n").alias("pool"))
    rest = pools.where(F.col("pool") < LEAST).agg(F.sum("pool")).first()[0] or 0
    return written(
        own.join(pools, "own_lang", "left").select(
            "own_cell",
            F.when(F.col("n") >= LEAST, F.col("own_cell"))
            .when(F.col("pool") >= LEAST, F.col("own_lang"))
            .when(F.lit(rest >= LEAST), F.lit("[]"))
            .alias("cell"),
        ),
        "cells",
    )


def quality(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Verdicts and the models that they follow from.

    Returns one row per document (``doc_id``, the counts, ``base_failed``,
    ``distance``, ``kept``), and centre and inverse covariance of each cell. Documents that fail a fixed
    bound are rejected and do not take part in the estimates. Null and empty texts
    have no words and fail. Null languages and sources are values like others. A
    document whose cell has no model, or that lies within the cut-off of its cell's,
    is kept. Rows that repeat an id are judged each by itself.
    """
    plain = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{text}`").alias("text"),
    )
    stats = written(measured(plain, "text", "lang", "source").drop("text", "lang", "source"), "stats")
    good = stats.where("NOT base_failed")
    places = cells(good)
    points = good.select("own_cell", *X).join(places.where("cell IS NOT NULL"), "own_cell")
    tables = Tables()
    model = fit(tables.written(points.select("cell", *X), "points"))
    tables.delete()
    models = written(places.join(model, "cell").select("own_cell", "centre", "inverse"), "models")
    return verdicts(stats, models), models


def quality_filter(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns."""
    added = ["own_cell", "own_lang", "base_failed", "distance", "kept", *STATS, *X]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    _, models = quality(plain, at[text], at[text], at[lang], at[source])
    judged = verdicts(measured(plain, at[text], at[lang], at[source]), models)
    return judged.where("kept").drop(*added).select(*plain.columns).toDF(*docs.columns)


def measured(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """The documents with counts, coordinates, ``own_cell``, ``own_lang``, ``base_failed``."""
    own_cell, own_lang = cell_of(lang, source)
    stats = with_stats(docs, text).withColumn("base_failed", base_failed())
    named = [c.alias(x) for c, x in zip(coordinates(), X, strict=True)]
    return stats.select("*", own_cell.alias("own_cell"), own_lang.alias("own_lang"), *named)


def verdicts(stats: DataFrame, models: DataFrame) -> DataFrame:
    """``measured`` documents with ``distance`` (null if not looked at) and ``kept``."""
    judged = stats.join(models, "own_cell", "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(distance(X))))
    far = F.coalesce(F.col("distance") > math.sqrt(chi_square(1 - REJECTED)), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).drop("centre", "inverse")
