"""Conversations as training texts, and the turns read back from them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import by_arrow, written
from marquee.llm.templates import Template, unescape

# A turn's role and text are escaped, so control strings stand for themselves only.
TURNS = (
    "{% for message in messages %}"
    "<turn {{ message.role | escape }}>"
    '{% if message.role == "assistant" %}'
    "{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    '</turn>{{ "\\n" }}'
    "{% endfor %}"
)
# Nothing that was read is given back (++, *+), so a turn of any length needs no stack.
TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL)
PIECE = "conv_id long, piece long, text string, generated array<struct<start:long,end:long>>"
# Rows, and characters of their texts, that go on at once (one row at least).
ROWS = 2000
CHARS = 1 << 20


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield from batch.slice(low, ROWS).to_pylist()


def batches_of(rows: Iterator[dict], kind: pa.StructType) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += len(row.get("text", ""))
        if len(held) == ROWS or chars >= CHARS:
            yield pa.RecordBatch.from_struct_array(pa.array(held, kind))
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_struct_array(pa.array(held, kind))


def formatted(
    turns: DataFrame,
    template: str = TURNS,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Conversations written by a template, in pieces: ``conv_id``, ``piece`` (from 0),
    ``text`` and the ``generated`` stretches of it (code points, the mask of the loss).

    A conversation's rows go by turn, equal turns by role and text; null roles and
    texts are empty, rows without a conversation or turn come under a null id and
    first. Rows stream through a task, so that a conversation of any length takes the
    memory of a few rows. Further columns are ignored.
    """
    Template(template)  # a template that can't be read is an error here, not in the tasks
    rows = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.struct(
        [
            ("conv_id", pa.int64()),
            ("piece", pa.int64()),
            ("text", pa.string()),
            ("generated", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template(template)

        def pieces() -> Iterator[dict]:
            for name, messages in groupby(rows_of(batches), key=lambda r: r["conv_id"]):
                plain = ({"role": m["role"], "text": m["text"]} for m in messages)
                for i, (out, stretches) in enumerate(made.pieces(plain)):
                    generated = [{"start": a, "end": b} for a, b in stretches]
                    yield {"conv_id": name, "piece": i, "text": out, "generated": generated}

        return batches_of(pieces(), kind)

    return rows.transform(by_arrow(run, PIECE))


def read_back(pieces: DataFrame) -> DataFrame:
    """What conversations of the template ``TURNS`` hold, one row each: ``conv_id``,
    ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed of each turn),
    ``loss_chars`` and ``loss_sha256`` (the generated texts, one after the other) and
    ``formatted_chars``. Texts are unescaped for the digests. A piece that isn't whole
    turns is an error."""
    kind = pa.struct(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[dict]:
            for name, rows in groupby(rows_of(batches), key=lambda r: r["conv_id"]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = 0
                for row in rows:
                    text, at = row["text"], 0
                    for found in TURN.finditer(text):
                        if found.start() != at:
                            break
                        turns.update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
                        n_turns, at = n_turns + 1, found.end()
                    if at != len(text):
                        raise ValueError(f"conversation {name}: not a whole turn")
                    for stretch in row["generated"]:
                        part = unescape(text[stretch["start"] : stretch["end"]])
                        loss.update(part.encode())
                        loss_chars += len(part)
                    chars += len(text)
                yield {
                    "conv_id": name,
                    "n_turns": n_turns,
                    "turns_sha256": turns.hexdigest(),
                    "loss_chars": loss_chars,
                    "loss_sha256": loss.hexdigest(),
                    "formatted_chars": chars,
                }

        return batches_of(conversations(), kind)

    ordered = written(pieces, "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.transform(by_arrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ))
