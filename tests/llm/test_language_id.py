from __future__ import annotations

import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from marquee.llm import language_id as li
from marquee.llm.queries import op7_naive_bayes_language
from tests.llm.rows import FOLDER, crc, documents, odd_rows


def test_held_out_accuracy(spark):
    folder = FOLDER.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op7_naive_bayes_language(spark, folder).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held_out = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert len(held_out) > 200 and np.mean(held_out) >= 0.98


def test_held_out_languages_are_not_learned(spark):
    """Wrong languages on the held-out documents change nothing."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = li.fit(docs.where("crc32(cast(doc_id AS string)) % 3 <> 1"))
    spoilt = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id AS string)) % 3 = 1, 'xx', lang) AS lang")
    again = li.fit(spoilt.where("crc32(cast(doc_id AS string)) % 3 <> 1"))
    assert model.langs == again.langs and (model.grams == again.grams).all()


def test_probabilities_against_brute_force(spark):
    texts = [("en", "The cat"), ("en", "a Hat"), ("de", "Die Katze é"), (None, "zzz"), ("de", None), ("fr", "日本")]
    model = li.fit(spark.createDataFrame(texts, "lang string, text string"))
    assert model.langs == ["de", "en", "fr"]

    def buckets(text: str) -> list[int]:
        return [int(b) for found, _ in li.gram_buckets([text]) for b in found]

    assert len(buckets("abcd")) == 4 + 3 + 2 and buckets("") == [] and len(buckets("é")) == 1
    counts = {x: Counter() for x in model.langs}
    for lang, text in texts:
        if lang:
            counts[lang].update(buckets(text or ""))
    prior = {"en": 2 / 5, "de": 2 / 5, "fr": 1 / 5}
    for text in ("the hat", "Katze", "é日", "q"):
        logs = []
        for lang in model.langs:
            total = sum(counts[lang].values()) + li.SMOOTHING * li.BUCKETS
            logs.append(math.log(prior[lang]) + sum(math.log((counts[lang][b] + li.SMOOTHING) / total) for b in buckets(text)))
        names, chance = model.predict([text, "", "12"])
        best = max(logs)
        assert names == [model.langs[logs.index(best)], "und", "und"]
        assert abs(chance[0] - 1 / sum(math.exp(v - best) for v in logs)) < 1e-4 and chance[1] == chance[2] == 0


@pytest.mark.parametrize("block", [3, 7, 64])
def test_blocks_change_nothing(monkeypatch, block):
    texts = ["", "ab", "The quick é日 brown", "c", "", "fox jumps over" * 9]
    model = li.Model(np.arange(3 * li.BUCKETS).reshape(3, -1) * 7 % 101, np.ones(3), ["a", "b", "c"])
    whole, names, chance = Counter(), *model.predict(texts)
    for buckets, of in li.gram_buckets(texts):
        whole.update(zip(buckets.tolist(), of.tolist(), strict=True))
    monkeypatch.setattr(li, "BLOCK", block)
    parts = Counter()
    for buckets, of in li.gram_buckets(texts):
        assert len(buckets) <= block
        parts.update(zip(buckets.tolist(), of.tolist(), strict=True))
    assert parts == whole and sum(whole.values()) == sum(max(0, len(t) - n) for t in texts for n in range(3))
    again = model.predict(texts)
    assert again[0] == names and np.allclose(again[1], chance)


def test_a_long_text_in_many_languages_takes_little_memory():
    model = li.Model(np.ones((li.MOST_LANGUAGES, li.BUCKETS)), np.ones(li.MOST_LANGUAGES), [f"l{i:03}" for i in range(li.MOST_LANGUAGES)])
    text = "the quick brown " * 50_000
    tracemalloc.start()
    names, chance = model.predict([text, "12"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == ["l000", "und"] and abs(chance[0] - 1 / li.MOST_LANGUAGES) < 1e-9 and peak < 200_000_000


def test_odd_rows(spark):
    docs = odd_rows(spark)
    model = li.fit(docs)
    assert model.langs == ["de", "en", "fr"]
    rows = li.identify(docs, model).collect()
    assert len(rows) == 15 and all(r["kept"] is True and r["ids"] == "ids" for r in rows)
    assert {r["lang_pred"] for r in rows if not (r["text"] or "").strip()} == {"und"}
    assert li.identify(odd_rows(spark, empty=True), model).collect() == []
    nothing = li.fit(odd_rows(spark, empty=True))
    assert {r["lang_pred"] for r in li.identify(docs, nothing).collect()} == {"und"}


def test_query_reads_whole_texts(spark):
    assert op7_naive_bayes_language(spark, FOLDER).count() == len(documents(spark))
