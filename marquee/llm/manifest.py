"""A Merkle tree over a table, and a proof for each of its rows.

Rows are ranked within their group, and a rank's base-16 digits name the row's places on
its way to the root. Within a block of three digits one digit column after another is
grouped away, the structs of the nodes below nested in the node above. A block's top is a leaf
of the next round, until each group has one block left; the groups' roots are the leaves of
the last tree. From the top down, blocks are exploded level by level, and every node takes the
path of the node above with its own siblings in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import Tables, crc_of_id

BITS = 4
FAN = 1 << BITS
# Digits of a block: it holds FAN ** LEVELS leaves at most, some 100 bytes each.
LEVELS = 3
BLOCK_BITS = BITS * LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<before: string, after: string>>"


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def with_length(value: Column) -> Column:
    """Length in bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*[with_length(v) for v in values]))


def ranked(frame: DataFrame, tables: Tables, group: list[str], order: list[str]) -> DataFrame:
    """The rows with ``rank`` within their group (from 0) and ``size`` of the group.

    Rows are sorted over all tasks by ranges of group and order, so a group of any size is
    spread; a row's rank is its place in its partition plus the group's rows in earlier
    ones. Nulls come first, and are a group.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    places = frame.repartitionByRange(*by).sortWithinPartitions(*by)
    places = tables.written(places.withColumn("place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("place", 33)
    counts = places.groupBy(*group, part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    whole = Window.partitionBy(*group)
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A row per partition and per group in it.
    starts = counts.select(
        *[F.col(c).alias(f"of_{c}") for c in group],
        "part",
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("size"),
    )
    starts = tables.written(starts, "starts")
    same = part == F.col("part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return places.join(starts, same).select(*frame.columns, (F.col("place") + F.col("shift")).alias("rank"), "size")


def joined(nodes: str) -> Column:
    return F.array_join(F.transform(nodes, lambda node: node["hash"]), "")


def rolled(nodes: DataFrame, tree: list[str], payload: list[str]) -> DataFrame:
    """Blocks of nodes: ``rank`` and ``size`` in blocks, ``hash``, and ``below``, the nested nodes."""
    digits = [f"digit{i}" for i in range(LEVELS)]
    places = [F.shiftright("rank", BITS * i).bitwiseAND(FAN - 1).alias(d) for i, d in enumerate(digits)]
    block = F.shiftright("rank", BLOCK_BITS).alias("block")
    frame = nodes.select(*tree, block, "size", *places, "hash", *payload).repartition(*tree, "block")
    inner = payload
    for i, digit in enumerate(digits):
        node = F.struct(digit, "hash", *inner)
        keys = [*tree, "block", "size", *digits[i + 1 :]]
        frame = frame.groupBy(*keys).agg(F.sort_array(F.collect_list(node)).alias("below"))
        # A node that is alone in its tree goes up as it is.
        up = F.when(F.col("size") > FAN**i, digest(joined("below"))).otherwise(F.col("below")[0]["hash"])
        frame = frame.withColumn("hash", up)
        inner = ["below"]
    size = F.ceil(F.col("size") / FAN**LEVELS).cast("long").alias("size")
    return frame.select(*tree, F.col("block").alias("rank"), F.col("size").alias("leaves"), size, "hash", "below")


def rounds(leaves: DataFrame, tables: Tables, tree: list[str], payload: list[str]) -> list[DataFrame]:
    """Blocks of each round; in the last one a tree has one block."""
    most = leaves.agg(F.max("size")).first()[0] or 1
    done = [tables.written(rolled(leaves, tree, payload), "blocks")]
    while (most := -(-most // FAN**LEVELS)) > 1:
        nodes = done[-1].select(*tree, "rank", "size", "hash")
        done.append(tables.written(rolled(nodes, tree, []), "blocks"))
    return done


def proven(blocks: DataFrame, paths: DataFrame, tree: list[str], payload: list[str], given: list[str]) -> DataFrame:
    """The leaves of blocks with the paths of the blocks put behind their own.

    ``paths`` has a row per block: ``path`` and what is ``given`` on to all leaves. Rows
    of both meet by grouping, two at a time.
    """
    keys = [*tree, "rank"]
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in ("leaves", "below", "path", *given)]
    frame = blocks.select(*keys, "leaves", "below").unionByName(
        paths.select(*keys, "path", *given), allowMissingColumns=True
    )
    frame = frame.groupBy(*keys).agg(*firsts).select(*tree, *given, "rank", "leaves", "path", "below")
    for i in reversed(range(LEVELS)):
        hashes = F.transform("below", lambda node: node["hash"])
        frame = frame.select(*tree, *given, "rank", "leaves", "path", hashes.alias("hashes"), F.posexplode("below").alias("at", "node"))
        at = F.col("at")
        step = F.struct(
            F.array_join(F.slice("hashes", F.lit(1), at), "").alias("before"),
            F.array_join(F.slice("hashes", at + 2, F.lit(FAN)), "").alias("after"),
        )
        path = F.when(F.col("leaves") > FAN**i, F.concat(F.array(step), "path")).otherwise(F.col("path"))
        rank = (F.shiftleft("rank", BITS) + F.col("node.digit" + str(i))).alias("rank")
        inner = ["node.below"] if i else ["node.hash", *[f"node.{c}" for c in payload]]
        frame = frame.select(*tree, *given, rank, "leaves", path.alias("path"), *inner)
    return frame.drop("leaves")


def manifest(leaves: DataFrame, tables: Tables, group: str, order: str, payload: list[str]) -> DataFrame:
    """Rows with ``hash`` (their leaf), ``subroot`` of their group, ``root``, and ``path``: the
    siblings before and after, level by level, first the leaf's own.

    Of equal ``order`` the smaller leaf comes first; null is a group, and comes first. The
    tables of a result's last step stay; the caller may delete them when it is done.
    """
    own = Tables()
    marked = own.written(leaves.select(group, order, "hash", *[c for c in payload if c != order]), "leaves")
    inner = list(dict.fromkeys([order, *payload]))
    subtrees = rounds(ranked(marked, own, [group], [order, "hash"]), tables, [group], inner)
    subroots = subtrees[-1].select(group, "hash")
    # The last tree is the only one of its kind.
    heads = ranked(subroots, own, [], [group]).withColumn("all", F.lit(0))
    top = rounds(heads, tables, ["all"], [group])
    own.delete()

    path = F.array().cast(STEP).alias("path")
    paths = top[-1].select("all", "rank", path, F.col("hash").alias("root"))
    for i in reversed(range(len(top))):
        paths = proven(top[i], paths, ["all"], [] if i else [group], ["root"])
    paths = paths.select(group, F.lit(0).cast("long").alias("rank"), "path", "root", F.col("hash").alias("subroot"))
    for i in reversed(range(len(subtrees))):
        paths = proven(subtrees[i], paths, [group], [] if i else inner, ["root", "subroot"])
    return paths.drop("rank")


def proof(path: str = "path") -> Column:
    """Digest of all siblings."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.reduce(path, leaf, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def document_manifest(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered text would fold to.

    ``doc_id`` is null at will: such rows come first in their source and are not tampered
    with. Rows that are equal in all five columns are leaves of their own. A null text stays null
    under tampering and an empty one empty, so they verify. An empty table has no
    rows and no root. Further columns are not looked at.
    """
    id_, source, lang, n_chars, text = (F.col(f"`{c}`") for c in FIELDS)
    tampered = leaf_of(id_, source, lang, n_chars, F.translate(text, UPPER, LOWER))
    leaves = docs.select(
        id_.alias("doc_id"),
        source.alias("source"),
        leaf_of(id_, source, lang, n_chars, text).alias("hash"),
        F.when(crc_of_id() % 5 == 0, tampered).alias("changed"),
    )
    found = manifest(leaves, tables or Tables(), "source", "doc_id", ["doc_id", "changed"])
    again = found.withColumn("folded_root", folded(F.coalesce("changed", "hash")))
    return again.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
