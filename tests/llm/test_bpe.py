from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import bpe, repair
from marquee.llm.chunks import ChunkEncoder
from marquee.llm.queries import op5_bpe_merge_replay
from tests.llm.rows import FOLDER, documents, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = [" ", "  ", "\n", "\t", "a", "the", "aaa", "'s", "'re", "1", "23", ".", "é", "日本", "　", "\x1c", "\x85", "--", "😀", "ing"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library()


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_equals_the_library(texts):
    coded = bpe.chunk_encoder(PATH, PATTERN)(texts)
    assert coded == [packed(LIBRARY.encode_ordinary(t)) for t in texts]
    assert [bpe.decoded(c, bpe.ranks(PATH)) for c in coded] == [t.encode() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_chunks_with_the_other_library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = repair.library_encoder(public_tokenizers.path("byte_bpe_50k.json"))(texts)
    assert coded == [packed(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_words():
    for text in ("a" * 5000, "ab" * 3000, "\n" * 999 + "x", "é" * 2000, "x1" * 4000):
        assert bpe.chunk_encoder(PATH, PATTERN)([text]) == [packed(LIBRARY.encode_ordinary(text))]


def test_a_merge_that_makes_a_lower_rank_goes_first():
    """Ranks in which a merge makes room for a lower one: leftmost lowest first, by hand."""
    table = bpe.Ranks.__new__(bpe.Ranks)
    names = [bytes([b]) for b in range(256)] + [b"abc", b"cc", b"ab", b"abcab"]
    table.id_of = {name: i for i, name in enumerate(names)}
    table.bytes_of = dict(enumerate(names))
    table.byte_ids = np.arange(256)
    table.merged = [{} for _ in names]
    for token, i in table.id_of.items():
        for at in range(1, len(token)):
            left, right = table.id_of.get(token[:at]), table.id_of.get(token[at:])
            if left is not None and right is not None:
                table.merged[left][right] = i
    table.byte_pairs = np.array([[table.merged[a].get(b, -1) for b in range(256)] for a in range(256)])

    def slow(word: bytes) -> list[int]:
        parts = [bytes([b]) for b in word]
        while True:
            ranked = [(table.id_of[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in table.id_of]
            if not ranked:
                return [table.id_of[p] for p in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = [b"abcabcabab", b"ababcab", b"ccabcc", b"abab", b"abccab", b"zz"]
    got = bpe.replay(words, table)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [slow(w) for w in words]


def test_memory_is_bounded():
    encoder = ChunkEncoder(lambda chunks: [np.frombuffer(c, np.uint8).astype("<u4").tobytes() for c in chunks], 3)
    for text in ("a b c d e", "e f g h i", "", "a  b \n c ", "One, two.\nThree 'four' (5)!", "a b c d e"):
        assert encoder([text, text]) == [packed(list(text.encode()))] * 2
    assert encoder.table.size <= 12


def test_query(spark):
    texts = documents(spark)
    rows = op5_bpe_merge_replay(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        ids = packed(LIBRARY.encode_ordinary(raw))
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(raw.encode()).hexdigest()


def test_odd_rows(spark):
    docs = odd_rows(spark)
    rows = bpe.encode_decode(docs, PATH, PATTERN).collect()
    assert len(rows) == 15 and "text" not in rows[0].asDict() and rows[0]["kept"] is True
    by_id = {(r["doc_id"], r["n_chars"]): r for r in rows}
    assert by_id[1, None]["ids"] == b"" == by_id[2, 0]["decoded"]
    plain = {(r["doc_id"], r["n_chars"]): r["text"] or "" for r in docs.collect()}
    long = [k for k in plain if k[0] in (8, 9)]
    assert len(long) == 2 and all(bytes(by_id[k]["decoded"]) == plain[k].encode() for k in long)
    assert bpe.encode_decode(odd_rows(spark, empty=True), PATH, PATTERN).collect() == []


