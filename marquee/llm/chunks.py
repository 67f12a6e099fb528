"""Texts as chunks that any pre-tokenizer of the GPT-2 kind treats separately."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np

from marquee.llm.words import U64, Words, join_texts, word_hashes

# Where the pattern ``'s|'t|…| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`` begins
# a piece whatever else the text holds:
# - at a single blank before a visible character; white space before that blank is
#   taken by ``\s+(?!\S)`` without it, at the end of a chunk as within a text,
# - at punctuation behind a letter, but for an apostrophe,
# - at a line feed behind a visible character.
# Visible are these first bytes; white space beyond ASCII begins with one of the
# bytes left out, and a chunk that is cut less is as right as any.
VISIBLE = np.zeros(256, dtype=bool)
VISIBLE[0x21:0x7F] = True
VISIBLE[0xC3:] = True
VISIBLE[[0xE1, 0xE2, 0xE3]] = False
ASCII_VISIBLE = VISIBLE.copy()
ASCII_VISIBLE[0x7F:] = False
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
PUNCTUATION = ASCII_VISIBLE & ~LETTER
PUNCTUATION[0x30:0x3A] = False
PUNCTUATION[0x27] = False

# Distinct chunks that an encoder remembers at most, and the places of the table for them.
REMEMBERED = 1_400_000
PLACES = 1 << 21


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Holds the search for cyclic garbage, which would walk through millions of strings
    and lists again and again; they are freed by their counts anyway."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class NumberOf:
    """Numbers of 64-bit keys in the order in which they came: open addressing, all
    keys of a call at once."""

    def __init__(self, places: int = PLACES) -> None:
        self.mask = U64(places - 1)
        self.keys = np.zeros(places, dtype=U64)
        self.numbers = np.full(places, -1, dtype=np.int32)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for unknown ones."""
        place = (keys & self.mask).astype(np.int64)
        out = self.numbers[place]
        wrong = np.flatnonzero((out >= 0) & (self.keys[place] != keys))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & int(self.mask)
            out[wrong] = self.numbers[place[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[place[wrong]] != keys[wrong])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """New keys, each once."""
        place = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.numbers[place[left]] < 0
            tried = left[free]
            # Of keys that want the same place, the last one written has it.
            self.numbers[place[tried]] = self.size + tried
            got = self.numbers[place[tried]] == self.size + tried
            self.keys[place[tried[got]]] = keys[tried[got]]
            left = np.concatenate([left[~free], tried[~got]])
            place[left] = (place[left] + 1) & int(self.mask)
        self.size += len(keys)


class Growing:
    """An array that is added to, with room for more."""

    def __init__(self, dtype: str) -> None:
        self.room = np.zeros(1 << 16, dtype=dtype)
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        needed = self.size + len(values)
        if needed > len(self.room):
            room = np.zeros(max(needed, len(self.room) * 3 // 2), dtype=self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : needed] = values
        self.size = needed

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class ChunkEncoder:
    """Token ids of texts as bytes, each distinct chunk encoded once.

    ``encode`` gets the new chunks of a run of texts together and returns the ids of
    each (little-endian 32-bit numbers). Chunks are told apart by 64-bit hashes.
    """

    def __init__(
        self, encode: Callable[[list[bytes]], list[bytes]], remembered: int | None = None
    ) -> None:
        self.encode = encode
        self.remembered = REMEMBERED if remembered is None else remembered
        self.forget()

    def forget(self) -> None:
        self.table = NumberOf()
        self.first = Growing("<i8")  # of each chunk's ids in the pool; one more
        self.first.add(np.zeros(1))
        self.pool = Growing("<u4")

    def __call__(self, texts: list[str]) -> list[bytes]:
        with no_cycle_search():
            return self.coded(texts)

    def coded(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        chunks = cut(texts)
        hashes = word_hashes(chunks)
        number = self.table.find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            if self.table.size > self.remembered:
                self.forget()
                missing = np.arange(len(hashes))
            fresh, place = np.unique(hashes[missing], return_index=True)
            place = missing[place]
            raw = chunks.data.tobytes()
            ids = self.encode([raw[a:b] for a, b in zip(chunks.start[place].tolist(), chunks.end[place].tolist(), strict=True)])
            sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
            self.first.add(self.pool.size + np.cumsum(sizes))
            self.pool.add(np.frombuffer(b"".join(ids), "<u4"))
            self.table.add(fresh)
            number[missing] = self.table.find(hashes[missing])
        low = self.first[number]
        sizes = self.first[number + 1] - low
        ends = np.cumsum(sizes)
        flat = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + sizes, sizes)]
        bounds = np.concatenate([[0], ends])[chunks.first].tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def cut(texts: list[str]) -> Words:
    """Chunks of all texts, a blank at the beginning included."""
    data, begins = join_texts(texts)
    one, two = data[:-1], data[1:]
    mark = np.zeros(len(data), dtype=bool)
    mark[:-1] = (one == 0x20) & VISIBLE[two]
    mark[1:] |= LETTER[one] & PUNCTUATION[two]
    mark[1:] |= (two == 0x0A) & ASCII_VISIBLE[one]
    # The line feeds between the texts are no part of them; a text begins a chunk.
    mark[begins[1:] - 1] = False
    mark[begins[:-1][np.diff(begins) > 1]] = True
    start = np.flatnonzero(mark)
    first = np.searchsorted(start, begins)
    end = np.append(start[1:], len(data))
    some = first[1:] > first[:-1]
    end[first[1:][some] - 1] = begins[1:][some] - 1
    return Words(data, start, end, np.zeros(0, dtype=np.int64), first)
