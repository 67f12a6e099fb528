"""SQL texts that were written for MySQL.

What Spark lacks are functions: ``STR_TO_DATE``, ``FIELD``, and date patterns with ``%`` marks.
They are session functions with a SQL body, which Catalyst puts into the query as plain
expressions; a constant pattern is translated once, when the query is planned. Two
things are settled in the text, outside of its quotes and comments: ``DATE_FORMAT`` gets the
session function's name, as a built-in one cannot be replaced, and ``FIELD`` of a name and
literals becomes its expression, as Spark takes no session function in ``ORDER BY``.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Marks of MySQL's date patterns, and Spark's letters to write and to read them.
WRITTEN = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%M": "MMMM", "%b": "MMM",
    "%d": "dd", "%e": "d", "%j": "DDD", "%W": "EEEE", "%a": "E",
    "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm",
    "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a",
    "%T": "HH:mm:ss", "%r": "hh:mm:ss a",
}
READ = {
    "%Y": "y", "%y": "yy", "%m": "M", "%c": "M", "%M": "MMMM", "%b": "MMM",
    "%d": "d", "%e": "d", "%j": "D",
}
# Names that FIELD compares with at most; Spark's functions have a fixed number of arguments.
MOST_OPTIONS = 64
# In the place of %% while the marks are translated.
PERCENT = "\\u0001"


def translated(pattern: str, marks: dict[str, str]) -> str:
    """SQL for a pattern with each mark replaced, other letters quoted; an unknown mark
    is an error."""
    text = f"replace(replace({pattern}, '''', ''''''), '%%', '{PERCENT}')"
    # Letters that follow a mark, a sign or nothing are text, and stay as they are.
    text = (
        f"regexp_replace({text}, "
        r"'(?<=%[A-Za-z]|[^%A-Za-z\\[\\]{}#\']|^)([A-Za-z\\[\\]{}#\']+)', '\'$1\'')"
    )
    for mark, letters in marks.items():
        text = f"replace({text}, '{mark}', '{letters}')"
    unknown = f"raise_error(concat('no such mark in date pattern ', {pattern}))"
    return f"replace(if({text} LIKE '%\\%%', {unknown}, {text}), '{PERCENT}', '%')"


def definitions() -> list[str]:
    options = ", ".join(f"o{i} STRING DEFAULT NULL" for i in range(MOST_OPTIONS))
    listed = ", ".join(f"o{i}" for i in range(MOST_OPTIONS))
    return [
        "CREATE OR REPLACE TEMPORARY FUNCTION mysql_date_format(moment TIMESTAMP_NTZ, pattern STRING) "
        f"RETURNS STRING RETURN date_format(moment, {translated('pattern', WRITTEN)})",
        # Dates only: a pattern with a time of day would need another type of result.
        "CREATE OR REPLACE TEMPORARY FUNCTION str_to_date(words STRING, pattern STRING) "
        f"RETURNS DATE RETURN try_to_date(words, {translated('pattern', READ)})",
        f"CREATE OR REPLACE TEMPORARY FUNCTION field(wanted STRING, {options}) "
        f"RETURNS INT RETURN CAST(coalesce(array_position(array({listed}), wanted), 0) AS INT)",
    ]


def mysql_functions(spark: SparkSession) -> None:
    """The functions for the session's own SQL texts."""
    for text in definitions():
        spark.sql(text)


LITERAL = r"""(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|[0-9.]+)"""
NAME = r"(?:`[^`]+`|\w+)(?:\.(?:`[^`]+`|\w+))*"
PIECES = re.compile(
    rf"""
    (?P<kept> '(?:[^'\\]|\\.|'')*' | "(?:[^"\\]|\\.|"")*" | `[^`]*` | --[^\n]* | /\*.*?\*/ )
    | \b field \s*\( \s* (?P<name>{NAME}) \s*,\s* (?P<options>{LITERAL}(?:\s*,\s*{LITERAL})*) \s*\)
    | \b (?P<format>date_format) (?=\s*\()
    """,
    re.IGNORECASE | re.VERBOSE | re.DOTALL,
)


def spark_text(text: str) -> str:
    """A MySQL text with the names that Spark knows these functions by."""

    def piece(found: re.Match[str]) -> str:
        if found["name"]:
            return f"coalesce(array_position(array({found['options']}), {found['name']}), 0)"
        return "mysql_date_format" if found["format"] else found[0]

    return PIECES.sub(piece, text)
