from __future__ import annotations

import hashlib
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import templates as t
from marquee.llm.chat import CHARS, TURN, TURNS, batches_of, formatted, read_back
from marquee.llm.queries import op9_chat_templates
from tests.llm.rows import FOLDER

TEXT = st.lists(st.sampled_from(["\\", "<", ">", "</turn>", "<turn user>", "a", "\n", "é", "### Assistant:", "{{ x }}"]), max_size=8).map("".join)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def written(source: str, *texts: str, **names) -> str:
    messages = [{"role": "user" if i % 2 == 0 else "assistant", "text": x} for i, x in enumerate(texts)]
    return "".join(text for text, _ in t.Template(source).pieces(messages, **names))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_turns_come_back(turns):
    messages = [{"role": role, "text": text} for role, text in turns]
    whole = "".join(p for p, _ in t.Template(TURNS).pieces(messages))
    assert [(t.unescape(a), t.unescape(b)) for a, b in TURN.findall(whole)] == turns
    assert t.unescape(t.escape(whole)) == whole


@pytest.mark.parametrize(
    ("source", "out"),
    [
        ('{{ "a" + "b" | upper }}{# no #}', "aB"),
        ("{% if true and not false %}x{% else %}y{% endif %}", "x"),
        ("{% if none %}x{% elif 1 == 1 %}z{% else %}y{% endif %}", "z"),
        ("{{ 1 + 2 }}{{ (1 == 2) or 'q' }}", "3q"),
        ('{{ "x\\n\\"" }}', 'x\n"'),
        ("{% for m in messages %}{{ loop.index }}{{ m.text }}{% if not loop.last %}, {% endif %}{% endfor %}.", "1p, 2q."),
        ("{% for m in messages %}{% if m.role == 'user' %}[{{ m.text | trim | length }}]{% endif %}{% endfor %}", "[1]"),
        ("{% for m in messages %}{% if loop.first %}{{ bos }}{% endif %}{{ loop.index0 }}{% endfor %}", "<s>01"),
    ],
)
def test_language(source, out):
    assert written(source, "p", "q", bos="<s>") == out


def test_folding():
    tree = t.fold(t.parse('a{{ "b" + 1 }}{% if 1 == 1 %}c{{ d }}{% endif %}{% if false %}{{ e }}{% endif %}{% generation %}{% endgeneration %}f'))
    assert tree == [t.Text("ab1c"), t.Output(t.Name("d")), t.Text("f")]


@pytest.mark.parametrize(
    "source",
    ["{{ a.__class__ }}", "{{ a() }}", "{{ a['b'] }}", "{% if %}", "{% for %}", "{% if true %}", "{{ a | eval }}", "{{ }}", "{% import os %}", "{{ a.b.c }}", "{{ 1 2 }}", "{% endif %}"],
)
def test_refused(source):
    with pytest.raises(t.TemplateError):
        t.Template(source)


def test_refused_while_writing():
    for source in ("{{ unknown }}", "{{ messages }}", "{{ bos.text }}"):
        with pytest.raises(t.TemplateError):
            written(source, "p", bos="x")


def test_generated_stretches():
    pieces = list(t.Template(TURNS).pieces([{"role": "user", "text": "hi"}, {"role": "assistant", "text": "<é>"}]))
    assert [[text[a:b] for a, b in stretches] for text, stretches in pieces] == [[], ["\\<é\\>"]]


def test_query(spark):
    rows = {r["conv_id"]: r for r in op9_chat_templates(spark, FOLDER).collect()}
    said = "\\### Assistant: </turn> ok"
    turns = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    conversations = {}
    for conv_id, _, role, text in sorted(turns):
        conversations.setdefault(conv_id, []).append((role, text or ""))
    assert set(rows) == set(conversations)
    for k, parts in conversations.items():
        loss = "".join(text for role, text in parts if role == "assistant")
        assert rows[k]["n_turns"] == len(parts)
        assert rows[k]["turns_sha256"] == digest("".join(f"{a}\n{b}\n" for a, b in parts))
        assert (rows[k]["loss_chars"], rows[k]["loss_sha256"]) == (len(loss), digest(loss))
        assert rows[k]["formatted_chars"] == sum(len(f"<turn {t.escape(a)}>{t.escape(b)}</turn>\n") for a, b in parts)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, "x"), (1, 2, "assistant", "a<b>\\", "x"), (1, 1, None, None, "x"), (1, 1, "x>y", "</turn>", "x"),
        (1, 1, "x>y", "</turn>", "x"), (None, 3, "assistant", "t", "x"), (2, 0, "assistant", "é" * 300_000, "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in read_back(formatted(turns)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {None: 2, 1: 4, 2: 1}
    assert got[1]["turns_sha256"] == digest("\n\nx>y\n</turn>\nx>y\n</turn>\nassistant\na<b>\\\n")
    assert got[2]["loss_chars"] == 300_000 and got[None]["loss_sha256"] == digest("t")
    assert read_back(formatted(turns.limit(0))).collect() == []


def test_other_order_of_rows(spark):
    turns = spark.createDataFrame([(5, i, "user", str(i)) for i in range(3000)], "conv_id long, turn long, role string, text string")
    (row,) = read_back(formatted(turns.orderBy("text").repartition(6))).collect()
    assert row["turns_sha256"] == digest("".join(f"user\n{i}\n" for i in range(3000)))


@pytest.mark.parametrize("text", ["a" * 16_000_000, "\\<" * 4_000_000], ids=["plain", "marked"])
def test_a_very_long_turn_takes_no_stack(text):
    whole = f"<turn user>{text}</turn>\n"
    tracemalloc.start()
    found = TURN.match(whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.span(2) == (11, 11 + len(text)) and peak < 1_000_000


def test_batches_are_bounded_by_characters():
    kind = pa.struct([("text", pa.string())])
    texts = ["x" * CHARS, "y", "z" * (CHARS // 2), "z" * (CHARS // 2), "", "w"]
    got = [b.num_rows for b in batches_of(({"text": x} for x in texts), kind)]
    assert got == [1, 3, 2]
