from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import quality as q
from marquee.llm.queries import op4_quality_outliers
from marquee.llm.text_stats import text_stats
from tests.llm.rows import FOLDER, documents, odd_rows, words_of


def brute(text: str) -> tuple[int, ...]:
    words = words_of(text, lower=False)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, n_lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if words_of(line):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), n_lines, dup, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\r\té#|日")), max_size=40), max_size=6))
def test_stats(texts):
    stats = text_stats(texts)
    assert list(zip(*[stats[s].tolist() for s in q.STATS], strict=True)) == [brute(t) for t in texts]


def test_chi_square():
    assert q.chi_square(0.5) == pytest.approx(4.351, rel=0.01)
    assert q.chi_square(0.975) == pytest.approx(12.83, rel=0.01)


def test_query(spark):
    texts = documents(spark)
    rows = {r["doc_id"]: r for r in op4_quality_outliers(spark, FOLDER).collect()}
    assert set(rows) == set(texts)
    for k, r in rows.items():
        words, chars, symbols, _, dup, repeated = brute(texts[k])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            words, chars, symbols, dup, repeated,
        )
        assert r["base_failed"] == (words < 50 or 100 * repeated > 50 * words)
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_follow_the_labels(spark):
    """Held against labels that the rules never see: good documents that pass the bounds
    stay, bad ones go."""
    folder = FOLDER.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL")
    rows = op4_quality_outliers(spark, folder).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 200 and np.mean(good) >= 0.99
    assert len(bad) > 20 and np.mean(bad) <= 0.1


def exact_mcd(x: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps on one machine, from the plain and the median start."""
    half, best = (len(x) + q.DIMS + 1) // 2, None
    floor = np.diag(np.square(q.FLOOR))
    spread = np.diff(np.percentile(x, [25, 75], axis=0), axis=0)[0] / 1.349
    for centre, cov in ((x.mean(0), np.cov(x.T, bias=True)), (np.median(x, 0), np.diag(spread**2))):
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov + floor), x - centre)
            near = x[np.argsort(d, kind="stable")[:half]]
            centre, cov = near.mean(0), np.cov(near.T, bias=True)
        det = np.linalg.slogdet(cov + floor)[1]
        if best is None or det < best[0]:
            best = det, centre, cov
    return best[1], best[2]


def test_robust_against_a_third_of_outliers(spark):
    """The estimate is that of the good two thirds, as on one machine; the plain mean is not."""
    rng = np.random.default_rng(1)
    good = rng.normal([5, 1.6, 0, 0, 0.1], [0.8, 0.1, 0.01, 0.01, 0.1], (400, 5))
    bad = rng.normal([7, 1.0, 0.9, 0.5, 0.5], 0.05, (200, 5))
    x = np.vstack([good, bad])
    points = spark.createDataFrame([("c", *map(float, r)) for r in x], "cell string, x0 double, x1 double, x2 double, x3 double, x4 double")
    model = q.fit(points).collect()
    assert len(model) == 1
    centre, inverse = np.array(model[0]["centre"]), np.array(model[0]["inverse"]).reshape(5, 5)
    reference, _ = exact_mcd(x)
    assert np.abs(centre - reference).max() < 0.1
    far = [np.einsum("ij,jk,ik->i", p - centre, inverse, p - centre) > q.chi_square(1 - q.REJECTED) for p in (good, bad)]
    assert far[0].mean() == 0 and far[1].mean() == 1


def test_each_coordinate_rejects(spark):
    """Documents of one cell without any repetition, and one far off in a single count."""
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")

    def words(n: int, letters_a_word: int = 7) -> list[str]:
        return ["".join(w) for w in rng.choice(letters, (n, letters_a_word))]

    def lines(of: list[str], a_line: int = 10) -> str:
        return "\n".join(" ".join(of[i : i + a_line]) for i in range(0, len(of), a_line))

    ordinary = [lines(words(int(n))) for n in rng.integers(150, 250, 400)]
    sample = words(200)
    odd = {
        "longer": lines(words(1600)),
        "long words": lines(words(200, 14)),
        "symbols": lines([w + " #" if i % 2 else w for i, w in enumerate(sample)]),
        # 8 of 20 lines are earlier ones of a word; no window of three words occurs twice.
        "lines": lines(sample[:160], 80) + "".join("\nsame\n" + w for w in sample[160:169]),
        # 80 of 200 words, the lines differ.
        "windows": lines(sample[:160] + sample[:40]).replace("\n", " "),
    }
    rows = [(i, t) for i, t in enumerate(ordinary)] + [(-1 - i, t) for i, t in enumerate(odd.values())]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in q.quality(docs)[0].collect()}
    assert all(got[i]["kept"] for i in range(len(ordinary)))
    for i, name in enumerate(odd):
        assert not got[-1 - i]["base_failed"] and not got[-1 - i]["kept"], (name, got[-1 - i])
    alone = got[-4], got[-5]
    assert [(r["n_dup_lines"] > 0, r["n_repeat_words"] > 0) for r in alone] == [(True, False), (False, True)]


def test_small_cells_are_joined(spark):
    rows = [("c%d" % i, "l%d" % (i % 3)) for i in range(9) for _ in range(10)] + [("big", "l0")] * 60
    points = spark.createDataFrame(rows, "own_cell string, own_lang string")
    got = {r["own_cell"]: r["cell"] for r in q.cells(points).collect()}
    # 30 documents of each language in small cells: too few even for a language, not for all.
    assert got == {"big": "big", **{f"c{i}": "[]" for i in range(9)}}
    assert {r["cell"] for r in q.cells(points.where("own_cell = 'c1'")).collect()} == {None}


def test_odd_rows(spark):
    docs = odd_rows(spark)
    verdicts, _ = q.quality(docs)
    rows = verdicts.collect()
    assert len(rows) == 15
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    kept = q.quality_filter(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
    assert q.quality_filter(odd_rows(spark, empty=True)).collect() == []
    assert q.quality(odd_rows(spark, empty=True))[0].collect() == []
