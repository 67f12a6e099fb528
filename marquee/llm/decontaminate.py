"""Benchmark passages in documents, up to a number of edits.

A passage with k edits that is cut into k + 1 pieces has one piece left untouched.
So the pieces of all items are looked for as they are, and only where one is found
is the edit distance worked out, with Myers's bit-parallel algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from marquee.llm.common import by_arrow, text_runs, written
from marquee.llm.words import U64

# Edits allowed, in percent of an item's characters.
ERROR_PERCENT = 6
# Characters of items that are looked for in one pass over the documents.
BLOCK_CHARS = 1 << 20
GRAM = 8

# Everything in ASCII but letters and digits separates words.
PLAIN = np.full(256, 32, dtype=np.uint8)
PLAIN[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = (
    list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))
)


def normal(text: str) -> bytes:
    """Lower case, words separated by single blanks, a blank at either end."""
    return normal_run([text])[0].tobytes()


def normal_run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normal forms of texts, one after the other, and where each begins."""
    parts = [b" " + t.lower().encode("utf-8") + b" " for t in texts]
    data = PLAIN[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    kept = np.ones(len(data), dtype=bool)
    kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
    kept[begins[:-1]] = True
    places = np.concatenate([[0], np.cumsum(kept)])
    return data[kept], places[begins]


def grams(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on as one number."""
    if len(data) < GRAM:
        return np.zeros(0, dtype=U64)
    whole = np.ascontiguousarray(data)
    return np.ndarray((len(whole) - GRAM + 1,), dtype="<u8", buffer=whole, strides=(1,))


def bucket(values: np.ndarray) -> np.ndarray:
    return (values * U64(0x9E3779B97F4A7C15)) >> U64(64 - 20)


class Pieces:
    """Pieces of one width (``GRAM`` stands for that and more bytes), to be looked up by
    their first bytes."""

    def __init__(self, width: int, rows: list[tuple[int, int, int, int, int]]) -> None:
        self.mask = U64((1 << 8 * width) - 1)
        first, last, size, item, offset = zip(*sorted(rows), strict=True)
        self.first, self.last = np.array(first, dtype=U64), np.array(last, dtype=U64)
        self.size, self.item, self.offset = (np.array(x, dtype=np.int64) for x in (size, item, offset))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[bucket(self.first)] = True
        self.width = width

    def hits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pieces, and the pieces."""
        begun = windows if self.width == GRAM else windows & self.mask
        likely = np.flatnonzero(self.filter[bucket(begun)])
        found = begun[likely]
        low = np.searchsorted(self.first, found, side="left")
        count = np.searchsorted(self.first, found, side="right") - low
        at = np.repeat(likely, count)
        piece = np.repeat(low, count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        end = at + self.size[piece] - self.width
        fits = end < len(windows)
        at, piece, end = at[fits], piece[fits], end[fits]
        same = windows[end] & self.mask == self.last[piece]
        return at[same], piece[same]


class Items:
    """Items of one block with an index of their pieces.

    An item that allows no edit is one piece: itself as whole words, with a blank at
    either end.
    """

    def __init__(self, rows: list[tuple[int, str]], error_percent: int) -> None:
        self.ids, self.texts, self.errors, self.masks = [], [], [], []
        pieces: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for item, text in rows:
            plain = normal(text).decode("utf-8").strip(" ")
            if not plain:
                continue
            allowed = len(plain) * error_percent // 100
            if not allowed:
                plain = f" {plain} "
            number = len(self.ids)
            self.ids.append(item), self.texts.append(plain), self.errors.append(allowed)
            masks: dict[str, int] = {}
            for i, c in enumerate(plain):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks.append(masks)
            cuts = [len(plain) * i // (allowed + 1) for i in range(allowed + 2)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                piece = plain[low:high].encode("utf-8")
                first, last = (int.from_bytes(p, "little") for p in (piece[:GRAM], piece[-GRAM:]))
                pieces.setdefault(min(len(piece), GRAM), []).append(
                    (first, last, len(piece), number, len(plain[:low].encode("utf-8")))
                )
        self.pieces = [Pieces(width, found) for width, found in sorted(pieces.items())]

    def hits(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces stand in normal texts: the text, the item, where the item would
        begin, and whether the bytes compared are the whole item."""
        # Bytes that no item has let short pieces be found up to the end.
        windows = grams(np.append(data, np.zeros(GRAM - 1, dtype=np.uint8)))
        out = []
        for some in self.pieces:
            at, piece = some.hits(windows)
            size, item, offset = some.size[piece], some.item[piece], some.offset[piece]
            of = np.searchsorted(begins, at, side="right") - 1
            inside = at + size <= begins[of + 1]
            whole = (np.array(self.errors, dtype=np.int64)[item] == 0) & (size <= 2 * GRAM)
            out.append([x[inside] for x in (of, item, at - offset, whole)])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def myers(masks: dict[str, int], size: int, text: str) -> int:
    """Smallest edit distance of the pattern to any part of the text."""
    whole, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = whole, 0, size, size
    for c in text:
        equal = masks.get(c, 0)
        straight = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | ~(across | up) & whole
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & whole, minus << 1 & whole
        up, down = minus | ~(straight | plus) & whole, plus & straight
        if score < best:
            best = score
            if not best:
                break
    return best


def found_in(items: Items, texts: list[str]) -> list[list[dict[str, int]]]:
    """Items in each text with their smallest distance."""
    out: list[list[dict[str, int]]] = [[] for _ in texts]
    data, begins = normal_run(texts)
    of, item, start, whole = items.hits(data, begins)
    if not len(of):
        return out
    best = {(int(t), int(n)): 0 for t, n in np.unique(np.stack([of[whole], item[whole]], axis=1), axis=0)}
    of, item, start = of[~whole], item[~whole], start[~whole]
    last: tuple[int, int, int] = (-1, -1, 0)
    for i in np.lexsort((start, item, of)):
        t, n, s = int(of[i]), int(item[i]), int(start[i])
        allowed = items.errors[n]
        # Four bytes for each edit may lie before or after; starts that are nearer to
        # each other than that share a stretch of text.
        slack = 4 * allowed + 4
        if (t, n) == last[:2] and s - last[2] <= slack:
            continue
        last = (t, n, s)
        if best.get((t, n)) == 0:
            continue
        size = len(items.texts[n].encode("utf-8"))
        low, high = max(int(begins[t]), s - slack), min(int(begins[t + 1]), s + size + 2 * slack)
        stretch = data[low:high].tobytes().decode("utf-8", "ignore")
        if items.texts[n] in stretch:
            distance = 0
        else:
            distance = myers(items.masks[n], len(items.texts[n]), stretch)
        if distance <= allowed:
            best[t, n] = min(distance, best.get((t, n), distance))
    for (t, n), distance in sorted(best.items()):
        out[t].append({"item_id": items.ids[n], "distance": distance, "allowed": items.errors[n]})
    return out


MATCHES = ArrayType(
    StructType([StructField("item_id", LongType()), StructField("distance", LongType()), StructField("allowed", LongType())])
)


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, read one after the other."""
    rows, size = [], 0
    plain = benchmark.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull())
    for row in plain.toLocalIterator():
        if rows and size + len(row[1]) > BLOCK_CHARS:
            yield rows
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += len(row[1])
    if rows:
        yield rows


def with_matches(docs: DataFrame, rows: list[tuple[int, str]], text: str, name: str, error_percent: int) -> DataFrame:
    """The documents with the items of one block that they hold, an array without nulls."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    source = docs.select(*[f"`{c}`" for c in kept])
    schema = StructType([*source.schema.fields, StructField(name, MATCHES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, error_percent)
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("item_id", "distance", "allowed")]))
        for part, texts in text_runs(batches, text):
            found = found_in(items, texts) if items.ids else [[] for _ in texts]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*kept, name])

    return source.transform(by_arrow(run, schema))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_percent: int = ERROR_PERCENT,
) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``distance``
    and ``allowed`` (edits).

    Case, punctuation and white space don't count. An item is found where its
    distance to some stretch of the document is at most ``error_percent`` of its
    length; none is missed. Short items that thus allow no edit are found as they are, as
    whole words. Null and empty texts hold nothing, null items and those without a letter
    or digit are nowhere; an item of several rows is reported for each. The
    items go to the tasks in blocks of ``BLOCK_CHARS``, one pass over the documents each.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts: list[DataFrame] = []
    for rows in blocks(benchmark, item_id, item_text):
        found = with_matches(plain, rows, "text", "found", error_percent)
        parts.append(found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*"))
        if len(parts) > 1:
            parts = [written(p, "found") for p in parts[:-1]] + [parts[-1]]
    if not parts:
        return plain.select("doc_id", *[F.lit(0).cast("long").alias(f.name) for f in MATCHES.elementType]).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    error_percent: int = ERROR_PERCENT,
) -> DataFrame:
    """The documents in which ``contaminated`` finds nothing, with all their columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = plain.columns[docs.columns.index(text)]
    several = False
    for rows in blocks(benchmark, item_id, item_text):
        if several:
            plain = written(plain, "clean")
        plain = with_matches(plain, rows, at, "found", error_percent).where("size(found) = 0").drop("found")
        several = True
    return plain.toDF(*docs.columns)
