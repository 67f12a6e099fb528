"""Byte-level BPE: merges replayed over all distinct words of a run of texts at once."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from marquee.llm.chunks import ChunkEncoder
from marquee.llm.common import by_arrow, text_runs

# Texts whose words are replayed together, and how many words at most.
CORPUS_BYTES = 2 << 20
CORPUS_WORDS = 40_000
# Distinct chunks and pieces that a worker remembers.
REMEMBERED_CHUNKS = 600_000
REMEMBERED_PIECES = 100_000


class Ranks:
    """Tokens by bytes and ids, and the id that each pair of tokens merges into."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.id_of = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {i: token for token, i in self.id_of.items()}
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)])
        # A pair merges if its bytes together are a token, however that came about:
        # by left token, then by right token.
        self.merged: list[dict[int, int]] = [{} for _ in range(max(self.bytes_of) + 1)]
        for token, i in self.id_of.items():
            for at in range(1, len(token)):
                left, right = self.id_of.get(token[:at]), self.id_of.get(token[at:])
                if left is not None and right is not None:
                    self.merged[left][right] = i
        # The same for pairs of single bytes; -1: they don't merge.
        self.byte_pairs = np.full((256, 256), -1, dtype=np.int64)
        for a, left in enumerate(self.byte_ids.tolist()):
            for b, right in enumerate(self.byte_ids.tolist()):
                self.byte_pairs[a, b] = self.merged[left].get(right, -1)


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def replay(words: list[bytes], table: Ranks) -> list[bytes]:
    """Token ids of each word (not empty) as little-endian 32-bit numbers.

    All words lie in one list of symbols. An inverted index holds, for each merge,
    the places of the pairs that it applies to; merges are taken in the order of
    their ranks, applied at all their places, and only the pairs with a new
    neighbour are put into the index. Within a word the leftmost pair of the lowest
    rank goes first: should a merge make a pair of a lower rank, that word's further
    places wait for it.
    """
    if not words:
        return []
    merged = table.merged
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    stops = np.cumsum([len(w) for w in words])
    links = np.arange(1, len(data) + 1)
    links[stops - 1] = -1
    after = links.tolist()
    links = np.arange(-1, len(data) - 1)
    links[stops[:-1]] = -1
    before = links.tolist()
    symbols = table.byte_ids[data].tolist()

    first = table.byte_pairs[data[:-1], data[1:]]
    first[stops[:-1] - 1] = -1
    order = np.argsort(first, kind="stable")
    kinds, counts = np.unique(first, return_counts=True)
    parts = np.split(order, np.cumsum(counts)[:-1])
    index = {k: p.tolist() for k, p in zip(kinds.tolist(), parts, strict=True) if k >= 0}
    heap = list(index)
    heapify(heap)

    while heap:
        rank = heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        wait_until, waiting = -1, []
        of_rank = merged[rank]
        for at in places:
            follower = after[at]
            symbol = symbols[at]
            if follower < 0 or symbol < 0 or merged[symbol].get(symbols[follower]) != rank:
                continue  # a neighbour has changed since
            if at < wait_until:
                waiting.append(at)
                continue
            symbols[at], symbols[follower] = rank, -1
            beyond = after[at] = after[follower]
            low = rank
            if beyond >= 0:
                before[beyond] = at
                new = of_rank.get(symbols[beyond])
                if new is not None:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heappush(heap, new)
                    if new < low:
                        low = new
            ahead = before[at]
            if ahead >= 0:
                new = merged[symbols[ahead]].get(rank)
                if new is not None:
                    if new in index:
                        index[new].append(ahead)
                    else:
                        index[new] = [ahead]
                        heappush(heap, new)
                    if new < low:
                        low = new
            if low < rank:
                wait_until = at
                while after[wait_until] >= 0:
                    wait_until = after[wait_until]
                wait_until += 1
        if waiting:
            if rank in index:
                index[rank].extend(waiting)
            else:
                index[rank] = waiting
                heappush(heap, rank)

    left = np.array(symbols)
    kept = np.flatnonzero(left >= 0)
    bounds = np.searchsorted(kept, stops).tolist()
    ids, low, out = left[kept].astype("<u4").tobytes(), 0, []
    for high in bounds:
        out.append(ids[4 * low : 4 * high])
        low = high
    return out


@lru_cache(maxsize=1)
def chunk_encoder(path: str, pattern: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker. It remembers some 60 MB, as workers go on
    with other stages."""
    table, pieces = ranks(path), regex.compile(pattern)
    known: dict[str, bytes] = {}

    def encode(raw: list[bytes]) -> list[bytes]:
        chunks = [c.decode("utf-8") for c in raw]
        # Letters behind a blank are one piece; the pattern is needed for the rest.
        cut = [(c,) if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else pieces.findall(c) for c in chunks]
        new = {p for parts in cut for p in parts}
        if len(known) > REMEMBERED_PIECES:
            kept = {p: known[p] for p in new.intersection(known)}
            known.clear()
            known.update(kept)
        rest = []
        for piece in new.difference(known):
            raw = piece.encode("utf-8")
            own = table.id_of.get(raw)
            if own is None:
                rest.append((piece, raw))
            else:  # a piece that is a token itself needs no merges
                known[piece] = own.to_bytes(4, "little")
        rest.sort()  # words alike lie near each other, which the cache rewards
        for low in range(0, len(rest), CORPUS_WORDS):
            part = rest[low : low + CORPUS_WORDS]
            coded = replay([raw for _, raw in part], table)
            known.update((piece, ids) for (piece, _), ids in zip(part, coded, strict=True))
        return [known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts]) for parts in cut]

    return ChunkEncoder(encode, REMEMBERED_CHUNKS)


def decoded(ids: bytes, table: Ranks) -> bytes:
    names = table.bytes_of
    return b"".join([names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def encode_decode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", back: str = "decoded"
) -> DataFrame:
    """The documents with ``ids`` (binary, little-endian 32-bit numbers) in the place of
    the text, and ``back``, the bytes that the ids stand for.

    Null and empty texts give no ids. A text of any length is encoded whole. All
    other columns stay; one named like a new column gives way to it.
    """
    kept = [c for c in docs.columns if c != text and c.lower() not in (ids.lower(), back.lower())]
    source = docs.select(*[f"`{c}`" for c in kept], f"`{text}`")
    schema = StructType([*source.drop(text).schema.fields, StructField(ids, BinaryType()), StructField(back, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, encoder = ranks(path), chunk_encoder(path, pattern)
        for part, texts in text_runs(batches, text, CORPUS_BYTES):
            coded = encoder(texts)
            again = [decoded(c, table) for c in coded]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(coded, pa.binary()), pa.array(again, pa.binary())], names=[*kept, ids, back]
            )

    return source.transform(by_arrow(run, schema))


def digests(ids: str = "ids", back: str = "decoded") -> list[Column]:
    """Columns ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of encoded documents."""
    return [
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(back, 256).alias("decoded_sha256"),
    ]
