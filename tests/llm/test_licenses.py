from __future__ import annotations

import re

import pytest

from marquee.llm import licenses as li
from marquee.llm.queries import op6_license_expressions
from tests.llm.rows import FOLDER, LOWER, documents, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text: str) -> tuple[int, list[int], set[str]]:
    words = WORD.findall(text.translate(LOWER))
    at, labels = [], set()
    for phrase, label in li.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                at.append(i)
                labels.add(label)
    return len(words), at, labels


@pytest.mark.parametrize(
    ("expression", "labels", "terms"),
    [
        ("MIT", {"mit"}, "permissive"),
        ("(MIT OR Apache-2.0)", {"mit", "apache-2"}, "permissive"),
        ("MIT AND GPL-3.0-or-later", {"mit", "gpl-3.0-or-later"}, "copyleft"),
        ("mit or gpl-3.0 and isc", {"mit", "gpl-3.0", "isc"}, "permissive"),
        ("(mit or gpl-3.0) and cc-by-nc-4.0", {"mit", "gpl-3.0", "cc-by-nc"}, "restricted"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only-with-classpath-exception-2.0"}, "weak-copyleft"),
        ("LicenseRef-x", {"licenseref-x"}, "unknown"),
    ],
)
def test_expressions(expression, labels, terms):
    got = li.evaluate(expression)
    assert got == (labels, li.TERMS.index(terms))


@pytest.mark.parametrize("expression", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "()", "MIT MIT", "MIT (ISC)", "(MIT OR ISC) WITH x"])
def test_malformed_expressions(expression):
    assert li.evaluate(expression) is None


def test_phrases_and_tags():
    texts = [
        "The MIT License the mit license",
        "themit license. The\nMIT-License! CC BY-NC 4.0",
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nx",
        "SPDX-License-Identifier: ) bad",
        "Apache License, Version 2.0; apache license version 23",
        "",
    ]
    n_words, n_base, first, last, base, labels, score, terms = li.scan(texts)
    for i, text in enumerate(texts):
        words, at, own = places(text)
        assert (n_words[i], n_base[i], first[i], last[i]) == (words, len(at), min(at, default=None), max(at, default=None))
        assert base[i] == sorted(own) and own <= set(labels[i])
    assert labels[2] == ["apache-2", "mit"] and score[2] == 1.0 and terms[2] == "permissive"
    assert labels[3] == [] and score[3] == 0.0 and terms[3] is None


def test_query(spark):
    texts = documents(spark)
    rows = op6_license_expressions(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words, at, own = places(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (
            words, len(at), min(at, default=None), max(at, default=None),
        )
        assert r["base_labels"] == ",".join(sorted(own)) and 0 <= r["score"] <= 1
        assert own <= set(r["labels"].split(","))


def test_odd_rows(spark):
    rows = li.licenses(odd_rows(spark)).collect()
    assert len(rows) == 15 and all(r["labels"] == [] and r["score"] == 0 for r in rows)
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert li.licenses(odd_rows(spark, empty=True)).collect() == []


@pytest.mark.parametrize(
    ("line", "labels"),
    [
        ("<!-- SPDX-License-Identifier: MIT -->", ["mit"]),
        ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */", ["apache-2", "mit"]),
        ("SPDX-License-Identifier: MIT (see LICENSE)", ["mit"]),
        ("SPDX-License-Identifier: Apache-2.0 and others apply here", ["apache-2", "others"]),
        ("It has SPDX-License-Identifier: MIT.", ["mit"]),
        ("SPDX-License-Identifier: (MIT OR ISC) OR -->", ["isc", "mit"]),
        ("SPDX-License-Identifier: GPL-2.0+ WITH", ["gpl-2.0+"]),
        ("SPDX-License-Identifier: (MIT) ISC", ["mit"]),
        ("SPDX-License-Identifier: MIT AND (ISC OR BSD) WITH x OR zlib", ["bsd", "isc", "mit"]),
        ("SPDX-License-Identifier: " + "MIT OR " * 20000 + "ISC", ["isc", "mit"]),
        ("SPDX-License-Identifier: -->", []),
    ],
)
def test_the_longest_beginning_of_a_tag_line(line, labels):
    assert li.scan([line])[5] == [labels]
    assert li.scan([line])[6] == [1.0 if labels else 0.0]


def test_the_base_phrases_of_the_contract():
    texts = ["Under the MIT License; the MIT license, under the mit license", "The MIT License (MIT)", "under the mit licenses"]
    _, n_base, first, last, base, labels, score, _ = li.scan(texts)
    assert (n_base, first, last) == ([2, 0, 0], [0, None, None], [7, None, None])
    assert base == [["mit"], [], []] and labels == [["mit"], ["mit"], []]
    assert score == [li.SURE["base"], li.SURE["notice"], 0.0]
