"""Joins on a key of which a few values hold very many rows.

AQE splits such a key only where its partition is large enough and both sides are plain.
Here the heavy values are found beforehand, by a sketch of bounded size that the map tasks
fill and Spark merges; their rows are dealt over several partitions, and the one row of the
other side is copied to each. All other rows join as ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Most values that a sketch follows, and that are taken for heavy.
FOLLOWED, MOST_HEAVY = 4096, 64
# Partitions that a heavy value's rows are dealt over.
PIECES = 32


def heavy_values(facts: DataFrame, key: str, share: float = 0.01) -> list:
    """Values that hold more than a share of all rows; the sketch may take one a little
    below it for one above, and misses none."""
    known = facts.where(F.col(key).isNotNull())
    top = F.expr(f"approx_top_k(`{key}`, {MOST_HEAVY}, {FOLLOWED})")
    row = known.agg(F.count(F.lit(1)).alias("rows"), top.alias("top")).first()
    return [found["item"] for found in row["top"] or [] if found["count"] > share * row["rows"]]


def spread_join(
    facts: DataFrame, others: DataFrame, key: str, share: float = 0.01, pieces: int = PIECES
) -> DataFrame:
    """Inner join on ``key``, with the heavy values' rows in ``pieces`` parts each.

    A row's part follows from all its columns, so a task that runs again deals alike. Equal
    rows stay together: a third of all rows must differ in something to be spread.
    """
    heavy = heavy_values(facts, key, share)
    if not heavy:
        return facts.join(others, key)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    piece = F.pmod(F.xxhash64(*facts.columns), F.lit(pieces))
    dealt = facts.withColumn("piece", F.when(is_heavy, piece).otherwise(F.lit(0).cast("bigint")))
    last = F.when(is_heavy, F.lit(pieces - 1)).otherwise(F.lit(0)).cast("bigint")
    copies = others.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return dealt.join(copies, [key, "piece"]).drop("piece")
