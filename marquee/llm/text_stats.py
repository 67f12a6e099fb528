"""Counts per text for quality rules, for a run of texts at once."""

from __future__ import annotations

import numpy as np

from marquee.llm.words import U64, Words, find_words, mix, word_hashes

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

TEXT_FACTOR = U64(0x9FB21C651E98DF25)


def per_text(marks: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Number of marked places in each text."""
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[begins[1:]] - sums[begins[:-1]]


def text_stats(texts: list[str]) -> dict[str, np.ndarray]:
    """``n_words``, ``word_chars`` (code points), ``n_symbols``, ``n_lines`` (with a word),
    ``n_dup_lines`` (of those, equal to an earlier one) and ``n_repeat_words`` (words in
    three-word windows that the text has twice or more)."""
    n = len(texts)
    words = find_words(texts, lower=False)
    data, counts = words.data, np.diff(words.first)
    ends = np.flatnonzero(data == 10)  # a line feed ends every line, and every text
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(lead[words.end] - lead[words.start])])

    starts = np.concatenate([[0], ends[:-1] + 1])
    full = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[full], ends[full]
    of = np.searchsorted(begins, starts, side="right") - 1
    lines = Words(data, starts, ends, of, np.searchsorted(of, np.arange(n + 1)))
    marks = mix(word_hashes(lines) + of.astype(U64) * TEXT_FACTOR)
    _, once = np.unique(marks, return_index=True)
    n_lines = np.bincount(of, minlength=n)

    repeated = np.zeros(len(words.start), dtype=bool)
    if len(words.start) >= 3:
        h = word_hashes(words)
        total = h[:-2] * U64(0x9E3779B97F4A7C15) + mix(h[1:-1]) * U64(0xC2B2AE3D27D4EB4F) + mix(~h[2:])
        inside = np.flatnonzero(words.text[:-2] == words.text[2:])
        marks = mix(total[inside]) + words.text[inside].astype(U64) * TEXT_FACTOR
        order = np.argsort(marks)
        same = marks[order][1:] == marks[order][:-1]
        twice = np.zeros(len(marks), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        for i in range(3):
            repeated[at + i] = True
    return {
        "n_words": counts,
        "word_chars": chars[words.first[1:]] - chars[words.first[:-1]],
        "n_symbols": per_text(SYMBOLS[data], begins),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(of[once], minlength=n),
        "n_repeat_words": per_text(repeated, words.first),
    }
