"""Rows that operators must stand, and helpers of the tests."""

from __future__ import annotations

import re
import zlib

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
# The columns after n_chars are further ones, with names that operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept boolean, ids string, found string, distance string, cell string, block string, n_words string"
)
EXTRA = (True, "ids", "found", "far", "cell", "block", "many")


def odd_rows(spark, empty: bool = False):
    ordinary = "the quick brown fox jumps over the lazy dog while token = abcdefghij0 waits and nobody minds at all "
    texts = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, " \n\t \n", None, "a", 5),
        (4, "one", "en", "a", 3),
        (5, "One two", "en", "a", 7),
        (6, "one TWO", None, None, 7),
        (None, None, None, None, None),
        (None, ordinary * 3, "en", "a", 1),
        (7, ordinary * 3, "en", "a", 1),
        (7, ordinary * 3, "en", "a", 1),
        (7, ordinary * 2 + "différent é 日本 😀", "fr", "a", 1),
        (8, LONG, "en", "a", len(LONG)),
        (9, "x" * 200_000, "en", "b", 200_000),
        (10, LONG + " end", "en", "a", 1),
        (11, "a\x00b \x1c \x85 c\r\nd # * $", "de", "b", 1),
    ]
    rows = [] if empty else [t + EXTRA for t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def words_of(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
