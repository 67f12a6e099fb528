from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from marquee.llm import near_dedup
from marquee.llm.components import components
from marquee.llm.near_dedup import first_of_group, folded, near_duplicates, parity_sketch
from tests.llm.rows import odd_rows, words_of


def brute(texts: dict[int, str | None], size: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for k, text in texts.items():
        words = words_of(text)
        n = max(len(words) - size + 1, 1 if words else 0)
        sets[k] = {tuple(words[i : i + size]) for i in range(n)}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    for k, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for other in where[x]:
                shared[other] += other > k
        for other, n in shared.items():
            if n and 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = sorted((find(k), find(other)))
                parent[b] = a
    return {k: (len(sets[k]), find(k)) for k in texts}


def copies(seed: int, n: int = 60) -> dict[int, str | None]:
    """Groups of copies with edits of all sizes, some pairs near the bound."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n", 3: "one two", 4: "One two", 5: "one"}
    for group in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))]
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            texts[len(texts) * 7 % 100_003] = " ".join(text).upper() if rng.random() < 0.3 else "\n".join(text)
    return texts


def check(spark, texts, size, percent):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    rows = near_duplicates(frame, size=size, percent=percent).collect()
    wanted = brute(texts, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and len(rows) == len(texts)


def test_against_brute_force(spark):
    check(spark, copies(1), 3, 85)
    check(spark, copies(2), 5, 80)


def test_split_buckets(spark, monkeypatch):
    """Buckets larger than a block: every link is still found, whatever the blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    check(spark, copies(3, 25), 3, 85)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = {}
    for k in range(400):
        text = list(base)
        for _ in range(k % 9):
            text[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(text)
    check(spark, texts, 3, 85)


def test_odd_rows(spark):
    rows = near_duplicates(odd_rows(spark), size=3, percent=85).collect()
    assert len(rows) == 15
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by_id[1] == [(0, 1, True)] and by_id[2] == [(0, 2, True)] and by_id[3] == [(0, 3, True)]
    assert by_id[4] == [(1, 4, True)]
    assert by_id[5] == [(1, 5, True)] and by_id[6] == [(1, 5, False)]  # equal but for case
    assert sorted(by_id[None], key=str) == [(0, None, True), (by_id[7][0][0], 7, False)]
    assert by_id[8][0][1] == by_id[10][0][1] == 8


def test_first_of_group_keeps_columns_and_one_row(spark):
    docs = odd_rows(spark)
    kept = first_of_group(docs, size=3, percent=85)
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "11", "2", "3", "4", "5", "7", "7", "8", "9", "None"]
    assert first_of_group(odd_rows(spark, empty=True)).collect() == []
    assert near_duplicates(odd_rows(spark, empty=True)).collect() == []


def test_parity_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for n in (10, 700, 5000):
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = common[: n - n // 10], common[n // 20 :]
        one, two = parity_sketch(a), parity_sketch(b)
        width = min(len(one), len(two))
        apart = int(np.bitwise_count(folded(one, width) ^ folded(two, width)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    edges += [(200, x) for x in range(201, 300)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    alone = {x for x in parent if all(a == b or x not in (a, b) for a, b in edges)}
    found = {r["node"]: r["root"] for r in components(frame).collect()}
    assert found == {x: find(x) for x in parent if x not in alone}
    assert components(frame.limit(0)).collect() == []
