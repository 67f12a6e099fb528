"""Near-duplicate documents: SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from marquee.llm.common import Tables, by_arrow, groups, text_runs, written
from marquee.llm.components import components
from marquee.llm.superminhash import bands, signature
from marquee.llm.words import U64, find_words, mix, windows, word_hashes

# Members of a bucket that one task compares at once; larger buckets are split.
BLOCK = 2048


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """Distinct hashed word windows of each text, sorted."""
    words = find_words(texts)
    hashes, text = windows(words, word_hashes(words), size)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        yield np.unique(hashes[first[i] : first[i + 1]])


def set_key(elements: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    return np.array([mix(elements).sum(), mix(elements ^ U64(0x5851F42D4C957F2D)).sum()], dtype=U64).tobytes()


def parity_bits(n: int) -> int:
    """Size of the parity sketch of a set: a power of two, 4 bits an element where the
    bounds allow it."""
    return min(1 << 17, max(2048, 1 << (4 * n - 1).bit_length()))


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """A bit per place, set where an odd number of elements falls. The bits in which
    two sketches differ never outnumber the elements in which the sets differ."""
    n = parity_bits(len(elements))
    places = (mix(elements ^ U64(0xA0761D6478BD642F)) & U64(n - 1)).astype(np.int64)
    odd = (np.bincount(places, minlength=n) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U64)


def folded(sketch: np.ndarray, n_words: int) -> np.ndarray:
    """The sketch with fewer places: halves laid over each other."""
    while len(sketch) > n_words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def may_link(sketches: np.ndarray, sizes: np.ndarray, one: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Of ``others``, those that may reach the similarity with ``one``; none is missed."""
    low, high = sizes[others], sizes[one]
    fits = 100 * np.minimum(low, high) >= percent * np.maximum(low, high)
    others = others[fits]
    apart = np.bitwise_count(sketches[others] ^ sketches[one]).sum(axis=1, dtype=np.int64)
    return others[(100 + percent) * apart <= (100 - percent) * (sizes[others] + sizes[one])]


def bucket_links(
    keys: list[bytes],
    sizes: np.ndarray,
    sketches: list[np.ndarray],
    labels: list[bytes],
    spanning: bool,
    percent: int,
) -> Iterator[tuple[bytes, bytes]]:
    """Links of one bucket that the sketches allow, between members of different labels.

    Members are compared with the first one, then what is not yet connected with the
    next, and so on; ``spanning`` leaves out links between connected members.
    """
    own = np.array([len(s) for s in sketches])
    flat = {
        int(w): np.stack([folded(s, w) if len(s) >= w else np.zeros(w, U64) for s in sketches])
        for w in np.unique(own)
    }
    first: dict[bytes, int] = {}
    root = np.array([first.setdefault(x, i) for i, x in enumerate(labels)])
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
    for at, i in enumerate(order[:-1]):
        rest = order[at + 1 :]
        rest = rest[root[rest] != root[i]]
        widths = np.minimum(own[rest], own[i])
        for w in np.unique(widths):
            for j in may_link(flat[int(w)], sizes, i, rest[widths == w], percent):
                if spanning and root[j] == root[i]:
                    continue
                yield keys[i], keys[j]
                if spanning:
                    root[root == root[j]] = root[i]


def similar_sets(
    docs: DataFrame, text: str, size: int, slots: int, rows: int
) -> DataFrame:
    """Per document: its columns but the text, ``n_shingles``, ``set_key``, ``bands`` and
    ``sketch``; a document without words has no key."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema
    schema = (
        schema.add("n_shingles", LongType())
        .add("set_key", BinaryType())
        .add("bands", ArrayType(LongType()))
        .add("sketch", BinaryType())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made = None, None
        for part, texts in text_runs(batches, text):
            counts, keys, all_bands, sketches = [], [], [], []
            for elements in shingle_sets(texts, size):
                counts.append(len(elements))
                if not len(elements):
                    keys.append(None), all_bands.append(None), sketches.append(None)
                    continue
                key = set_key(elements)
                if key != last:
                    last = key
                    made = (bands(signature(elements, slots), rows).view(np.int64), parity_sketch(elements).tobytes())
                keys.append(key), all_bands.append(made[0]), sketches.append(made[1])
            at = part.schema.get_field_index(text)
            rest = [c for i, c in enumerate(part.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest,
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(all_bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=[*kept, "n_shingles", "set_key", "bands", "sketch"],
            )

    return docs.select(*[f"`{c}`" for c in kept], f"`{text}`").transform(by_arrow(run, schema))


def compare(members: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """Links (``a`` < ``b``) in blocks of buckets: ``bucket``, ``block``, ``set_key``,
    ``n_shingles``, ``sketch``, ``label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in groups(batches, ["bucket", "block"]):
            keys = part.column("set_key").to_pylist()
            sizes = part.column("n_shingles").to_numpy()
            labels = part.column("label").to_pylist()
            raw = part.column("sketch").to_pylist()
            found: set[tuple[bytes, bytes]] = set()
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if high - low < 2:
                    continue
                found.update(
                    bucket_links(
                        keys[low:high],
                        sizes[low:high],
                        [np.frombuffer(x, dtype=U64) for x in raw[low:high]],
                        labels[low:high],
                        spanning,
                        percent,
                    )
                )
            ends = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([min(p) for p in ends], pa.binary()), pa.array([max(p) for p in ends], pa.binary())],
                names=["a", "b"],
            )

    return (
        members.repartition("bucket", "block")
        .sortWithinPartitions("bucket", "block", "set_key")
        .transform(by_arrow(run, "a binary, b binary"))
        .distinct()
    )


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs with ``linked``, decided on the full sets; ``texts``: ``set_key``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            verdicts = []
            a, b = batch.column(0).to_pylist(), batch.column(1)
            for i in range(batch.num_rows):
                if a[i] != last:
                    last = a[i]
                    one = next(shingle_sets([batch.column(2)[i].as_py()], size))
                two = next(shingle_sets([batch.column(3)[i].as_py()], size))
                both = len(np.intersect1d(one, two, assume_unique=True))
                verdicts.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), b, pa.array(verdicts)], names=["a", "b", "linked"])

    left = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        .transform(by_arrow(run, "a binary, b binary, linked boolean"))
    )


def blocks_of(count: Column) -> Column:
    return F.ceil(count / F.lit(BLOCK))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Groups of documents whose sets of ``size``-word shingles reach a Jaccard
    similarity of ``percent`` in a hundred: one row per document with ``doc_id``,
    ``text_hash``, ``n_shingles``, ``component_id`` and ``kept``.

    Linked documents and what they are linked with form a component, named by its
    smallest id; the document of that id is kept. Null and empty texts and texts of
    separators only have no shingles, are linked with nothing and are kept. Equal
    sets are one class from the start. Rows that repeat an id get a row each; a null
    id takes part, but names a component only if all its ids are null. Further
    columns of the input are ignored. Documents are compared if one of the bands
    agrees, which a pair at the bound itself misses once in a million pairs.
    """
    # A pair at the bound misses all bands with a probability below 1e-6.
    rows = 6 if percent >= 85 else 5 if percent >= 78 else 3
    n_bands = int(np.ceil(np.log(1e-6) / np.log(1 - (percent / 100) ** rows)))
    docs = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(f"`{text}`").alias("text_hash"),
        F.col(f"`{text}`").alias("text"),
    )
    sets = written(similar_sets(docs, "text", size, n_bands * rows, rows), "sets")
    tables = Tables()

    with_key = sets.where("set_key IS NOT NULL")
    classes = with_key.groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"),
        F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    classes = tables.written(classes, "classes")
    # Positions in buckets, without the wide columns.
    placed = classes.select("set_key", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("set_key").alias("pivot"))
    buckets = tables.written(buckets.where("members > 1"), "buckets")

    blocks = blocks_of(F.col("members"))
    placed = placed.join(buckets, "bucket").select(
        "bucket", "set_key", "members", F.pmod(F.xxhash64("set_key"), blocks).alias("block")
    )
    placed = tables.written(placed, "members")
    # Every block of a split bucket also gets the bucket's first member.
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    pivots = buckets.where(F.col("members") > BLOCK).select(
        "bucket", F.col("pivot").alias("set_key"), "members", F.explode(every).alias("block")
    )
    wide = classes.select("set_key", "n_shingles", "sketch")
    members = placed.unionByName(pivots).distinct().join(wide, "set_key")
    pairs = compare(members.withColumn("label", F.col("set_key")), percent, True)
    pairs = tables.written(pairs, "pairs")
    texts = tables.written(class_texts(docs, wanted_classes(classes, pairs)), "texts")
    checked = tables.written(verified(pairs, texts, size, percent), "checked")
    links = checked.where("linked").select("a", "b")
    roots = tables.written(components(links), "roots")

    # Where buckets still hold several components, a link may have been left out for
    # one that did not hold, or its ends were in different blocks.
    labelled = placed.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "bucket", "set_key", "members", "block", F.coalesce("root", "set_key").alias("label")
    )
    labelled = tables.written(labelled, "labelled")
    open_buckets = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_buckets = tables.written(open_buckets.where("low <> high").select("bucket"), "open")
    again = labelled.join(open_buckets, "bucket").withColumn("blocks", blocks_of(F.col("members")))
    n = F.col("blocks")
    others = F.sequence(F.lit(0).cast("long"), n - 1)
    with_each = F.transform(others, lambda o: F.least("block", o) * n + F.greatest("block", o))
    again = again.select("bucket", "set_key", "label", F.explode(with_each).alias("block")).join(wide, "set_key")
    more = compare(again, percent, False).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = tables.written(more, "pairs")
    if not more.isEmpty():
        # Few as a rule, and written, so that Spark may send them to the documents.
        wanted = tables.written(wanted_classes(classes, more), "wanted")
        found = verified(more, tables.written(class_texts(docs, wanted), "texts"), size, percent)
        roots = tables.written(components(links.unionByName(found.where("linked").select("a", "b"))), "roots")

    # Names: the smallest id among all classes of a component.
    rooted = classes.select("set_key", "first_id").join(roots.withColumnRenamed("node", "set_key"), "set_key")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("set_key", "root").join(names, "root").select("set_key", "component_id")
    named = classes.select("set_key", "first_id").join(named, "set_key", "left")
    final = written(named.select("set_key", F.coalesce("component_id", "first_id").alias("component_id")), "components")
    tables.delete()

    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    lonely = sets.where("set_key IS NULL").withColumn("component_id", F.col("doc_id")).select(*columns)
    joined = sets.where("set_key IS NOT NULL").join(final, "set_key")
    return (
        joined.select(*columns)
        .unionByName(lonely)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def wanted_classes(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes in the pairs, with id and hash of their first text."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    return keys.join(classes.select("set_key", "first_id", "text_hash"), "set_key")


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set_key`` and one text of each of the classes."""
    same_id = docs["doc_id"].eqNullSafe(wanted["first_id"])
    found = docs.join(wanted, same_id & (docs["text_hash"] == wanted["text_hash"]))
    return found.select("set_key", "text").dropDuplicates(["set_key"])


def first_of_group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns.

    Of rows with the same id and text one stays; a row without an id stays if its
    component has no id at all, or it has no shingles.
    """
    verdicts = near_duplicates(docs, doc_id, text, size, percent).where("kept")
    kept = verdicts.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        (F.count("*") * F.col("doc_id").isNotNull().cast("int")).alias("rows")
    )
    kept = written(kept, "kept")
    key = [F.col(f"`{doc_id}`").cast("long").alias("\x00id"), F.xxhash64(f"`{text}`").alias("\x00hash")]
    marked = docs.select("*", *key)

    def found(rows: DataFrame) -> DataFrame:
        same = marked["\x00id"].eqNullSafe(rows["id"]) & (marked["\x00hash"] == rows["hash"])
        return marked.join(rows, same, "left_semi")

    columns = [f"`{c}`" for c in docs.columns]
    out = found(kept.where("rows <= 1")).select(*columns)
    # Only rows that repeat are compared with each other.
    repeated = kept.where("rows > 1")
    if not repeated.isEmpty():
        once = found(repeated).dropDuplicates(["\x00id", "\x00hash"])
        out = out.unionByName(once.select(*columns))
    return out
