"""Words and their 64-bit hashes for a batch of texts, found on the UTF-8 bytes.

All separators are ASCII, and no byte of a longer UTF-8 sequence is ASCII, so
words of bytes are words of characters. A word's hash is a polynomial over its
bytes modulo 2**64, mixed at the end; two different words of a corpus share one
with a probability of about (number of words)**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the splitmix64 finaliser)."""
    x = np.asarray(x).astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in the order in which they come, and which one each is: by
    hashing, where ``np.unique`` sorts."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def first_places(which: np.ndarray, n: int) -> np.ndarray:
    """Where each of n numbers is found first."""
    first = np.empty(n, dtype=np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return first


# A random number for each byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))

POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i < n, modulo 2**64."""
    if len(POWERS.get("up", ())) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            POWERS[name] = np.cumprod(steps, dtype=U64)
    return POWERS["up"], POWERS["down"]


@dataclass
class Words:
    """Words of a batch of texts, in order; positions count bytes of ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # number of the word's text in the batch
    first: np.ndarray  # number of each text's first word; one more entry than texts


def join_texts(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a line feed after each, and where each begins."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    return data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The bytes from each start to its end."""
    sizes = end - start
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + sizes, sizes)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[places]))]
    )


def find_words(
    texts: Sequence[str | None], lower: bool = True, between: np.ndarray = SPACES
) -> Words:
    """Words between the ``between`` bytes; null texts have none. ``lower`` maps A-Z only."""
    data, begins = join_texts(texts)
    if lower:
        data = LOWER[data]
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[0] = False
    np.logical_not(between[data], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    first = np.searchsorted(start, begins)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, text, first)


def word_hashes(words: Words) -> np.ndarray:
    """One 64-bit number per word."""
    if not len(words.start):
        return np.zeros(0, dtype=U64)
    # Powers restart for every block of bytes, so their table stays small.
    block = 1 << 18
    out = np.empty(len(words.start), dtype=U64)
    at = 0
    while at < len(words.start):
        low = words.start[at]
        upto = max(at + 1, int(np.searchsorted(words.end, low + block, side="right")))
        high = words.end[upto - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, dtype=U64)
        np.cumsum(BYTE_CODES[words.data[low:high]] * up[: high - low], out=sums[1:])
        s, e = words.start[at:upto] - low, words.end[at:upto] - low
        out[at:upto] = mix((sums[e] - sums[s]) * down[s])
        at = upto
    return out


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words and the number of its text.

    A text with fewer words, but at least one, has one run: all its words.
    """
    counts = np.diff(words.first)
    n = len(hashes)
    factors = mix(np.arange(1, size + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    if n >= size:
        total = np.zeros(n - size + 1, dtype=U64)
        for i in range(size):
            total += hashes[i : n - size + 1 + i] * factors[i]
        same = words.text[: n - size + 1] == words.text[size - 1 :]
        long_hash, long_text = mix(total[same]), words.text[: n - size + 1][same]
    else:
        long_hash, long_text = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return long_hash, long_text
    short_hash = np.empty(len(short), dtype=U64)
    for k in range(1, size):
        those = counts[short] == k
        total = np.full(int(those.sum()), k, dtype=U64)
        for i in range(k):
            total += hashes[words.first[short[those]] + i] * factors[i]
        short_hash[those] = mix(total)
    all_hash = np.concatenate([long_hash, short_hash])
    all_text = np.concatenate([long_text, short])
    order = np.argsort(all_text, kind="stable")
    return all_hash[order], all_text[order]
