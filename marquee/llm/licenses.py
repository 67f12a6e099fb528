"""Licences named in texts: identifier tags with their expressions, and notice phrases."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from marquee.llm.common import with_columns

# Phrases in words, and the labels that they stand for.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICE_PHRASES = {
    "the mit license": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier:[\x20\t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
# A name begins with a letter or digit; a dot or hyphen at its end is not part of it.
TOKEN = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?")
NEXT = re.compile(rf"[\x20\t]*({TOKEN.pattern})")

# What may be done, from free to closed; what is not listed counts as unknown.
TERMS = ("public", "permissive", "weak-copyleft", "copyleft", "unknown", "restricted")
TERMS_OF = {
    "cc0": "public",
    "unlicense": "public",
    "mit": "permissive",
    "apache": "permissive",
    "bsd": "permissive",
    "isc": "permissive",
    "zlib": "permissive",
    "cc-by": "permissive",
    "mpl": "weak-copyleft",
    "lgpl": "weak-copyleft",
    "epl": "weak-copyleft",
    "gpl": "copyleft",
    "agpl": "copyleft",
    "cc-by-sa": "copyleft",
    "cc-by-nc": "restricted",
    "proprietary": "restricted",
}
# How sure a find is: a well-formed expression, a base phrase, a notice.
SURE = {"tag": 1.0, "base": 0.9, "notice": 0.8}

# Words are lower-case letters, digits and everything beyond ASCII.
WORD = np.full(256, 32, dtype=np.uint8)
WORD[48:58] = np.arange(48, 58)
WORD[65:91] = np.arange(97, 123)
WORD[97:123] = np.arange(97, 123)
WORD[128:] = np.arange(128, 256)

PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def shunting_yard(tokens: list[str]) -> list[str] | None:
    """The expression in postfix order, or None if it is not well formed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # what is expected next
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif low in PRECEDENCE:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def label_of(name: str) -> str:
    """Label of a licence identifier: the base labels for theirs, else the identifier."""
    low = name.lower()
    if low in ("apache-2", "apache-2.0"):
        return "apache-2"
    if re.fullmatch(r"cc-by-nc(-[0-9.]+)?", low):
        return "cc-by-nc"
    return low


def terms_of(label: str) -> int:
    """Place in ``TERMS``, by the longest listed beginning of the label."""
    parts = label.split("-")
    for n in range(len(parts), 0, -1):
        if (known := TERMS_OF.get("-".join(parts[:n]))) is not None:
            return TERMS.index(known)
    return TERMS.index("unknown")


def evaluate(expression: str) -> tuple[set[str], int] | None:
    """Labels of a licence expression and the terms it leaves: the freer of
    alternatives, the stricter of what holds together; an exception to a copyleft
    licence makes it a weak one. None for what is not well formed."""
    postfix = shunting_yard(TOKEN.findall(expression))
    if postfix is None:
        return None
    stack: list[tuple[set[str], int]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            label = label_of(token)
            stack.append(({label}, terms_of(label)))
            continue
        (right, right_terms), (left, left_terms) = stack.pop(), stack.pop()
        if token == "with":
            # Only a licence takes an exception, and an exception is a single name.
            if len(left) != 1 or len(right) != 1:
                return None
            name = f"{next(iter(left))}-with-{next(iter(right))}"
            weak = min(left_terms, TERMS.index("weak-copyleft")) if left_terms == TERMS.index("copyleft") else left_terms
            stack.append(({name}, weak))
        else:
            choose = min if token == "or" else max
            stack.append((left | right, choose(left_terms, right_terms)))
    return stack[0]


def evaluate_line(line: str) -> tuple[set[str], int] | None:
    """``evaluate`` of the longest well-formed beginning of the rest of a tag's line, which
    may go on with the end of a comment or with prose. The tokens of an expression have
    nothing but blanks between them."""
    tokens, ends, at, depth, operand = [], [], 0, 0, True
    while found := NEXT.match(line, at):
        token = found[1]
        if (token == "(" or token not in ")" and token.lower() not in PRECEDENCE) != operand:
            break
        if token in "()":
            depth += 1 if token == "(" else -1
        else:
            operand = not operand
        if depth < 0:
            break
        tokens.append(token)
        at = found.end()
        if not depth and not operand:
            ends.append(len(tokens))
    # A beginning that has no value has none however it goes on.
    good, bad, value = 0, len(ends) + 1, None
    while bad - good > 1:
        middle = (good + bad) // 2
        now = evaluate(" ".join(tokens[: ends[middle - 1]]))
        if now is None:
            bad = middle
        else:
            good, value = middle, now
    return value


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases and the tag, as words between blanks."""
    found = ahocorasick.Automaton()
    phrases = [*BASE_PHRASES, *(p for p in NOTICE_PHRASES if p not in BASE_PHRASES), TAG]
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(texts: list[str]) -> list[list]:
    """Columns of ``FIELDS`` for a run of texts."""
    parts = [b" " + t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = WORD[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    blank = data == 32
    kept = np.ones(len(data), dtype=bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    kept[begins[:-1]] = True
    places = np.concatenate([[0], np.cumsum(kept)])
    data, begins = data[kept], places[begins]
    # A word starts after each blank but the last of its text.
    blanks = np.flatnonzero(data == 32)
    first = np.searchsorted(blanks, begins)
    n_words = np.diff(first) - 1

    base_at: list[list[int]] = [[] for _ in texts]
    base: list[set[str]] = [set() for _ in texts]
    labels: list[set[str]] = [set() for _ in texts]
    score = [0.0] * len(texts)
    terms: list[int | None] = [None] * len(texts)
    tagged: set[int] = set()
    # Bytes as characters, so that positions stay those of the bytes. Two blanks
    # between texts keep phrases from reaching over.
    for end, phrase in automaton().iter(data.tobytes().decode("latin-1")):
        start = end - len(phrase) - 1
        i = int(np.searchsorted(begins, start, side="right")) - 1
        if phrase == TAG:
            tagged.add(i)
            continue
        if phrase in BASE_PHRASES:
            base_at[i].append(int(np.searchsorted(blanks, start) - first[i]))
            base[i].add(BASE_PHRASES[phrase])
            kind, label = "base", BASE_PHRASES[phrase]
        else:
            kind, label = "notice", NOTICE_PHRASES[phrase]
        labels[i].add(label)
        score[i] = max(score[i], SURE[kind])
        terms[i] = max(terms_of(label), terms[i] or 0)
    for i in sorted(tagged):
        for line in TAG_LINE.finditer(texts[i]):
            value = evaluate_line(line[1])
            if value is not None:
                labels[i] |= value[0]
                score[i] = max(score[i], SURE["tag"])
                terms[i] = max(value[1], terms[i] or 0)
    return [
        n_words,
        [len(a) for a in base_at],
        [min(a, default=None) for a in base_at],
        [max(a, default=None) for a in base_at],
        [sorted(b) for b in base],
        [sorted(x) for x in labels],
        score,
        [None if t is None else TERMS[t] for t in terms],
    ]


FIELDS = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_base", LongType()),
        StructField("first_word", LongType()),
        StructField("last_word", LongType()),
        StructField("base_labels", ArrayType(StringType())),
        StructField("labels", ArrayType(StringType())),
        StructField("score", DoubleType()),
        StructField("terms", StringType()),
    ]
)


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences of each document: ``doc_id`` and ``FIELDS``.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are
    the first and last of them (words from 0; null without any). ``labels`` has those
    of base phrases, notices and tag expressions (the longest well-formed beginning of
    a tag's line). ``score`` is how sure
    the surest find is, 0 without one; ``terms`` are the strictest of the finds, null
    without one. Null and empty texts have no words. Rows that repeat an id are
    looked at each; further columns are ignored.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_columns(plain, "text", FIELDS, scan).drop("text")
