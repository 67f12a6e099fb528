"""Token ids in files compressed by a grammar, with access to any document.

A shard holds the ids of some consecutive documents. Re-Pair replaces frequent pairs
of neighbours by new symbols until no pair is frequent any more; here each round
replaces all frequent pairs at once, the more frequent first where two overlap. The
number of ids that each symbol stands for is stored, so that the symbols of a
stretch of ids are found by a search in running sums, and only they are expanded.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.chunks import ChunkEncoder
from marquee.llm.common import by_arrow, text_runs, written

MAGIC = b"RPR1"
# Pairs that occur less often in a shard stay.
LEAST_PAIRS = 24
# A round that shortens the shard by less than this share is the last one.
LEAST_GAIN = 0.01
# Ids of a shard; a longer document has a shard of its own.
SHARD_IDS = 1 << 19
HASH_BITS = 18
# Chunks that the library encodes in one text; it takes longer for each one in longer texts.
JOINED = 64
U32, U64 = np.uint32, np.uint64
# Bytes that may be white space, or begin it, within a chunk.
INNER_SPACE = np.zeros(256, dtype=bool)
INNER_SPACE[:0x21] = INNER_SPACE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def spread(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * U64(0x9E3779B97F4A7C15)) >> U64(64 - HASH_BITS)).astype(np.int64)


def compress(ids: np.ndarray, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols of the ids, the pair and the expanded length of each rule, and the
    first rule's symbol (rules are numbered from there)."""
    first = int(ids.max()) + 1 if len(ids) else 1
    symbols, rules = ids.astype(U32), [np.zeros((0, 2), U32)]
    lengths = [np.zeros(0, U32)]
    known = first
    length_of = np.ones(first, U32)
    while len(symbols) > 1:
        pairs = symbols[:-1].astype(U64) << U64(32) | symbols[1:]
        place = spread(pairs)
        crowded = np.bincount(place, minlength=1 << HASH_BITS) >= least
        at = np.flatnonzero(crowded[place])
        if not len(at):
            break
        # One pair for each crowded place of the table; others have their turn later.
        chosen = np.zeros(1 << HASH_BITS, U64)
        pairs, place = pairs[at], place[at]
        chosen[place] = pairs
        own = pairs == chosen[place]
        at, place = at[own], place[own]
        counts = np.bincount(place, minlength=1 << HASH_BITS)
        frequent = np.flatnonzero(counts >= least)
        if not len(frequent):
            break
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")]
        rank_at = np.full(1 << HASH_BITS, len(frequent), np.int32)
        rank_at[frequent] = np.arange(len(frequent), dtype=np.int32)
        here = rank_at[place]
        at, here = at[here < len(frequent)], here[here < len(frequent)]
        # Of overlapping pairs the more frequent one; of a run of equal ones every other.
        near = np.diff(at) == 1
        ahead, after = np.full((2, len(at)), len(frequent), np.int32)
        ahead[1:][near], after[:-1][near] = here[:-1][near], here[1:][near]
        every = np.arange(len(at))
        offset = every - np.maximum.accumulate(np.where(here != ahead, every, 0))
        free = (offset > 0) | (here < ahead)
        first_of = np.flatnonzero((offset % 2 == 0) & free & (here <= after))
        taken, here = at[first_of], here[first_of]
        used = np.flatnonzero(np.bincount(here, minlength=len(frequent)))
        number_of = np.zeros(len(frequent), U32)
        number_of[used] = np.arange(len(used))
        new = chosen[frequent[used]]
        pair = np.stack([(new >> U64(32)).astype(U32), new.astype(U32)], axis=1)
        rules.append(pair)
        lengths.append(length_of[pair[:, 0]] + length_of[pair[:, 1]])
        length_of = np.concatenate([length_of, lengths[-1]])
        before = len(symbols)
        symbols = symbols.copy()
        symbols[taken] = U32(known) + number_of[here]
        keep = np.ones(before, bool)
        keep[taken + 1] = False
        symbols = symbols[keep]
        known += len(used)
        if before - len(symbols) < LEAST_GAIN * before:
            break
    return symbols, np.concatenate(rules), np.concatenate(lengths), first


def packed(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """File of a shard: the ids of its documents, one after the other, and their numbers."""
    symbols, rules, lengths, first = compress(ids)
    head = struct.pack("<4sIQQQ", MAGIC, first, len(sizes), len(rules), len(symbols))
    body = [sizes.astype("<u4"), rules.astype("<u4"), lengths.astype("<u4"), symbols.astype("<u4")]
    return head + b"".join(a.tobytes() for a in body)


class Shard:
    """A file of ``packed``, read back."""

    def __init__(self, file: bytes) -> None:
        magic, self.first, n_docs, n_rules, n_symbols = struct.unpack_from("<4sIQQQ", file)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at, parts = struct.calcsize("<4sIQQQ"), []
        for n in (n_docs, 2 * n_rules, n_rules, n_symbols):
            parts.append(np.frombuffer(file, "<u4", n, at))
            at += 4 * n
        sizes, rules, self.lengths, self.symbols = parts
        self.rules = rules.reshape(-1, 2)
        self.doc_ends = np.cumsum(sizes, dtype=np.int64)
        own = np.ones(len(self.symbols), np.int64)
        made = self.symbols >= self.first
        own[made] = self.lengths[self.symbols[made] - self.first]
        self.ends = np.cumsum(own)
        # What each rule stands for, one after the other; rules use earlier ones only.
        self.rule_ends = np.cumsum(self.lengths, dtype=np.int64)
        self.full = np.zeros(int(self.rule_ends[-1]) if n_rules else 0, U32)
        low = 0
        for (a, b), high in zip(self.rules.tolist(), self.rule_ends.tolist(), strict=True):
            middle = low + self._put(low, a)
            self._put(middle, b)
            low = high

    def _put(self, at: int, symbol: int) -> int:
        """Writes what a symbol stands for, and returns how much that is."""
        if symbol < self.first:
            self.full[at] = symbol
            return 1
        rule = symbol - self.first
        size, end = int(self.lengths[rule]), int(self.rule_ends[rule])
        self.full[at : at + size] = self.full[end - size : end]
        return size

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        made = symbols >= self.first
        if not made.any():
            return symbols
        # Where each symbol's ids lie: in what rules stand for, or behind that as they are.
        rule = symbols[made] - self.first
        sizes = np.ones(len(symbols), np.int64)
        sizes[made] = self.lengths[rule]
        low = len(self.full) + np.arange(len(symbols))
        low[made] = self.rule_ends[rule] - sizes[made]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(low - ends + sizes, sizes)
        return np.concatenate([self.full, symbols])[places]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the shard; only their symbols are expanded."""
        if start >= stop:
            return np.zeros(0, U32)
        low = int(np.searchsorted(self.ends, start, side="right"))
        high = int(np.searchsorted(self.ends, stop, side="left")) + 1
        before = int(self.ends[low - 1]) if low else 0
        return self.expanded(self.symbols[low:high])[start - before : stop - before]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.doc_ends[number - 1]) if number else 0, int(self.doc_ends[number]))

    def documents(self) -> Iterator[np.ndarray]:
        """All documents, for which everything is expanded once."""
        whole = self.expanded(self.symbols)
        low = 0
        for high in self.doc_ends.tolist():
            yield whole[low:high]
            low = high


def around(tokens: dict[str, int], encode: Callable[[list[str]], list[bytes]]) -> Callable[[list[str]], list[bytes]]:
    """An encoder of texts that may hold strings of special tokens: each is one id, the
    longest where several begin, and what lies between is encoded as a text of its own."""
    if not tokens:
        return encode
    longest = sorted(tokens, key=len, reverse=True)
    special = re.compile("(" + "|".join(re.escape(t) for t in longest) + ")")
    ids = {t: np.array([i], dtype="<u4").tobytes() for t, i in tokens.items()}

    def encode_all(texts: list[str]) -> list[bytes]:
        # Every second piece is a token.
        pieces = [special.split(t) for t in texts]
        if all(len(p) == 1 for p in pieces):
            return encode(texts)
        coded = iter(encode([part for p in pieces for part in p[::2]]))
        return [b"".join(ids[x] if i % 2 else next(coded) for i, x in enumerate(p)) for p in pieces]

    return encode_all


@lru_cache(maxsize=1)
def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids as the tokenizers library gives them, special tokens in the texts included."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
        raise ValueError("special tokens that depend on their neighbours are not known here")
    # They are found before texts are cut into chunks; none is left inside a chunk.
    tokenizer.encode_special_tokens = True

    separator = tokenizer.encode("\n", add_special_tokens=False).ids

    def joins(chunks: list[bytes]) -> np.ndarray:
        """Whether each chunk is a blank with no white space nor a special token behind it."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        data = np.frombuffer(b"".join(chunks) + b"\0", np.uint8)
        ends = np.cumsum(sizes)
        inner = INNER_SPACE[data]
        inner[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        before = np.concatenate([[0], np.cumsum(inner)])
        begins = ends - sizes
        # The blank itself is one of them.
        return (len(separator) == 1) & (data[begins] == 0x20) & (sizes > 0) & (sizes < 200) & (before[ends] - before[begins] == 1)

    def encode(chunks: list[bytes]) -> list[bytes]:
        # A chunk without white space, behind its blank, keeps its ids in a text of many
        # chunks with line feeds between them: these are pieces, and tokens, of their own.
        out: list[bytes] = [b""] * len(chunks)
        joined = joins(chunks)
        rest = np.flatnonzero(~joined).tolist()
        # Chunks alike lie near each other, which the processor's cache rewards.
        plain = sorted(np.flatnonzero(joined).tolist(), key=chunks.__getitem__)
        for low in range(0, len(plain), JOINED):
            part = plain[low : low + JOINED]
            text = b"\n".join([chunks[i] for i in part]).decode("utf-8")
            ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(ids == separator[0])
            if len(stops) != len(part) - 1:
                rest.extend(part)
                continue
            flat, low_id = ids.tobytes(), 0
            for i, stop in zip(part, [*stops.tolist(), len(ids)], strict=True):
                out[i] = flat[4 * low_id : 4 * stop]
                low_id = stop + 1
        coded = tokenizer.encode_batch([chunks[i].decode("utf-8") for i in rest], add_special_tokens=False)
        for i, c in zip(rest, coded, strict=True):
            out[i] = np.array(c.ids, dtype="<u4").tobytes()
        return out

    return around({t.content: i for i, t in added.items()}, ChunkEncoder(encode))


def write_shards(
    docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], doc_id: str, text: str, end: int = 0
) -> DataFrame:
    """Files of the documents' ids in ascending order of ``doc_id``, as a table.

    ``part`` and ``shard`` give the order of the files, ``doc_ids`` what they hold,
    ``n_ids`` how many ids. Every document ends with the id ``end``. Documents are
    dealt out by ranges of their ids; null ids come first, equal ones by text.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    source = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        coder = encoder()
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def file() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            sizes = np.array([len(i) // 4 for i in ids])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([shard], pa.int64()),
                    pa.array([len(flat)], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([packed(flat, sizes)], pa.binary()),
                ],
                names=["part", "shard", "n_ids", "doc_ids", "file"],
            )

        for rows, texts in text_runs(batches, "text", 2 << 20):
            for name, coded in zip(rows.column(0).to_pylist(), coder(texts), strict=True):
                if ids and size + len(coded) // 4 + 1 > SHARD_IDS:
                    yield file()
                    shard, size = shard + 1, 0
                    ids.clear(), names.clear()
                ids.append(coded + stop), names.append(name)
                size += len(coded) // 4 + 1
        if ids:
            yield file()

    return written(source.transform(by_arrow(run, "part long, shard long, n_ids long, doc_ids array<long>, file binary")), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents read back: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets, sizes, sums, at = [], [], [], 0
                for ids in Shard(row["file"]).documents():
                    offsets.append(at), sizes.append(len(ids))
                    sums.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                    at += len(ids)
                n = len(sizes)
                columns = [[row["part"]] * n, [row["shard"]] * n, row["doc_ids"], offsets, sizes, sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("part", "shard", "doc_ids", "file").transform(by_arrow(
        run, "part long, shard long, doc_id long, offset long, n_tokens long, ids_crc32 long"
    ))
    # Ids before a shard: those of earlier parts (one row each), and of earlier shards of its part.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("of_parts"))
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("of_shards"))
    starts = written(starts.join(parts, "part"), "starts")
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("of_parts") + F.col("of_shards") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' ids written to files and read back, one row per document.

    A null or empty text is its end id alone; rows that repeat an id are documents
    of their own. Further columns are ignored.
    """
    return read_shards(write_shards(docs, lambda: library_encoder(path), doc_id, text))
