from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm.queries import op2_credential_linking
from marquee.llm.secrets import redacted, secrets
from tests.llm.rows import FOLDER, documents, odd_rows

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text: str) -> list[tuple[int, int, str, int]]:
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def named(spans) -> list[str]:
    return [f"{kind}:{start}:{end}" for start, _, kind, end in spans]


PARTS = ["token", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "abcdefgh", "abc", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "é", "日", "\n", "-", "ſ"]


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=40))
def test_base_kinds(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secrets(frame).collect()}
    for k, text in enumerate(texts):
        assert rows[k]["base_spans"] == named(base(text)), text
        assert set(rows[k]["base_spans"]) <= set(rows[k]["spans"])


def found(spark, *texts: str) -> list[list[str]]:
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["spans"] for r in secrets(frame).orderBy("doc_id").collect()]


def test_parts_count_only_together(spark):
    loose, user, place = "k9f3a7d2b8c4e6g1h5", "user=bob", "https://db.example/x"
    alone, pair, triple, far, apart, short, unnamed, nothing, url = found(
        spark,
        f"see {loose} there",
        f"{user} {loose}",
        f"{place} {user} {loose}",
        f"{user} {'x ' * 200}{loose}",
        f"{user}\n \n{loose}",
        "login: bob, token=abcd",
        "curl https://api.example.com/v1 -H 'X-Auth-Key: 4f9aB2c8D1e7F6a5'",
        f"{place} {user}",
        "see https://db.example/articles/2024/a-long-title and no more",
    )
    assert alone == [] and apart == [] and nothing == [] and url == []
    assert far == ["identifier:0:8", "loose:409:427"]
    assert unnamed == ["endpoint:5:31", "loose:48:64"]
    assert pair == ["identifier:0:8", "loose:9:27"]
    assert triple == ["endpoint:0:20", "identifier:21:29", "loose:30:48"]
    assert short == ["identifier:0:10", "loose:12:22"]


def test_base_finds_are_complements(spark):
    key = "AKIA" + "A1B2C3D4E5F6"
    (spans,) = found(spark, f"{key} with k9f3a7d2b8c4e6g1h5 at 10.0.0.1:5432")
    assert spans == ["access:0:16", "loose:22:40", "endpoint:44:57"]


def test_linked_against_brute_force(spark):
    """Many parts in texts of many scopes: the same links as by all pairs within a scope."""
    import random

    rng = random.Random(4)
    kinds = {
        "identifier": "user=bob",
        "loose": "k9f3a7d2b8c4e6g1h5",
        "endpoint": "https://db.example/x",
        "buried": "https://db.example/k9f3a7d2b8c4e6g1h5",
    }
    texts = []
    for size in (400, 400, 40):
        words = [rng.choice([*kinds.values(), "plain " * rng.randint(1, 400), *["\n \n"] * 3]) for _ in range(size)]
        texts.append(" ".join(words))
    texts.append(" ".join(rng.choice([kinds["loose"], "plain " * 90]) for _ in range(400)) + " " + kinds["endpoint"])

    def of(text: str) -> list[str]:
        out = []
        edges = [0, *[m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)], len(text)]
        for low, high in zip(edges, edges[1:], strict=False):
            parts = [(m.start(), m.end(), "identifier", "id") for m in re.finditer("user=bob", text)]
            for m in re.finditer(r"https://\S+", text):
                parts.append((m.start(), m.end(), "endpoint", "place"))
            for m in re.finditer(kinds["loose"], text):
                inside = text[m.start() - 1 : m.start()] == "/"
                # The run of a path begins after the last dot of the address.
                parts.append((m.start() - 8 * inside, m.end(), "loose", "buried" if inside else "secret"))
            parts = [p for p in parts if low <= p[0] < high]
            pairs = {("id", "secret"), ("id", "buried"), ("place", "secret")}
            both = {x for a in parts for b in parts if (a[3], b[3]) in pairs for x in (a, b)}
            if any(a[3] == "id" for a in both) and any(a[3] == "buried" for a in both):
                both |= {p for p in parts if p[3] == "place"}
            out += [f"{k}:{s}:{e}" for s, e, k, _ in both]
        return sorted(out)

    for spans, text in zip(found(spark, *texts), texts, strict=True):
        assert sorted(spans) == of(text)
        assert spans


def test_query(spark):
    texts = documents(spark)
    rows = op2_credential_linking(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = base(texts[r["doc_id"]])
        counts = [sum(kind == k for _, _, kind, _ in wanted) for k in ("assign", "access", "hex")]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(named(wanted)).encode()).hexdigest()


def test_no_python(spark):
    plan = op2_credential_linking(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows(spark):
    docs = odd_rows(spark)
    rows = secrets(docs).collect()
    assert len(rows) == 15
    assert all(r["n_assign"] == 3 and len(r["spans"]) == 3 for r in rows if r["doc_id"] == 7 and r["n_assign"] > 2)
    assert all(r["spans"] == [] for r in rows if r["doc_id"] in (1, 2, 3, 4, 5, 6))
    masked = redacted(docs)
    assert masked.schema == docs.schema and masked.count() == 15
    plain = {(r["doc_id"], r["n_chars"]): r["text"] for r in docs.collect() if r["doc_id"] != 7}
    for r in masked.collect():
        if r["doc_id"] is None or r["doc_id"] == 7:
            assert r["text"] is None or "abcdefghij0" not in r["text"] and "[SECRET]" in r["text"]
        else:
            assert r["text"] == plain[r["doc_id"], r["n_chars"]]
    assert redacted(odd_rows(spark, empty=True)).collect() == [] == secrets(odd_rows(spark, empty=True)).collect()


def test_masks_of_linked_parts(spark):
    far = "user: alice99 " + "word " * 60 + "4f9aB2c8D1e7F6a5"
    texts = ["curl https://api.example.com/v1 -H 'X-Auth-Key: 4f9aB2c8D1e7F6a5'", far]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in redacted(frame).orderBy("doc_id").collect()] == [
        "curl [SECRET] -H 'X-Auth-Key: [SECRET]'",
        "[SECRET] " + "word " * 60 + "[SECRET]",
    ]


def test_masks_join(spark):
    frame = spark.createDataFrame([(1, "é token = '" + "a1" * 20 + "' end")], "doc_id long, text string")
    assert redacted(frame).first()["text"] == "é [SECRET]' end"
