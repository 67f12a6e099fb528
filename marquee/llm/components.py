"""Connected components: union-find inside tasks, then star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import Tables, by_arrow


class UnionFind:
    """Sets of hashable, comparable things; the smallest one names its set."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            self.parent.setdefault(a, a)
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True


FOREST_NODES = 500_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as links from each node to the smallest of its set; the sets
    are given out and begun anew once they hold ``FOREST_NODES`` nodes."""
    sets = UnionFind()

    def links(kind) -> pa.RecordBatch:
        pairs = [(x, sets.find(x)) for x in sets.parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        a = pa.array([p[0] for p in pairs], type=kind)
        return pa.RecordBatch.from_arrays(
            [a, pa.array([p[1] for p in pairs], type=kind)], names=["a", "b"]
        )

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > FOREST_NODES:
            yield links(kind)
            sets = UnionFind()
    if kind is not None:
        yield links(kind)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of the edges (columns ``a`` and ``b``, any
    orderable type); the root is the smallest node of the component.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until nothing
    changes; a node's neighbours are only ever reduced to their minimum, so a node
    with many of them is no large group. Null ends and loops are left out.
    """
    columns = edges.select("a", "b")
    kept, old = Tables(), Tables()
    edges = kept.written(columns.where("a <> b").transform(by_arrow(contract, columns.schema)), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of u to the smallest around u.
        large = both.where("b > a").join(least, F.col("a") == F.col("u"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = old.written(large, "links")
        # Small star: u and its smaller neighbours to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        link = F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        own = F.struct(F.col("u").alias("a"), F.col("m").alias("b"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(link, own)).alias("e"))
        old.paths += kept.paths
        kept = Tables()
        edges = kept.written(small.select("e.*").where("a <> b").distinct(), "links")
        old.delete()
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first())
        # Stars: another round has changed nothing.
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
