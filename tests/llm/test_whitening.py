"""Whitening against numpy's eigenvectors and Python's integers."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest

from marquee.llm.queries import op11_lanczos_whitening
from marquee.llm.whitening import NOTHING, Centre, bidiagonalised, whiten
from tests.llm.rows import FOLDER

NAN, INF = float("nan"), float("inf")
RANDOM = np.random.default_rng(3)


def expected(vectors, count=8):
    """Whole numbers, deviations, eigenvalues, projections (but for the sign) and the trace."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    far = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, vecs = np.linalg.eigh(far.T @ far / n)
    values, vecs = values[::-1][:count], vecs[:, ::-1][:, :count]
    return deviations, values, far @ vecs, np.square(far).sum() / n


@pytest.mark.parametrize(
    "rows",
    [
        RANDOM.standard_normal((3000, 64)),
        RANDOM.standard_normal((800, 30)) * np.logspace(0, -6, 30),
        RANDOM.standard_normal((500, 3)) @ RANDOM.standard_normal((3, 20)),
        np.repeat(np.eye(12), 40, axis=0) * 300,
        RANDOM.standard_normal((5, 40)),
    ],
    ids=["even", "steep", "rank 3", "equal values", "few rows"],
)
def test_bidiagonalisation(rows):
    rows = rows - rows.mean(axis=0)
    values, vectors = bidiagonalised(lambda q: rows.T @ (rows @ q), rows.shape[1], 8)
    right = np.linalg.svd(rows)[1][:8]
    assert np.abs(values[: len(right)] - right).max() < 1e-11 * right[0]
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
    there = values > NOTHING * values[0]
    image = rows.T @ (rows @ vectors[:, there])
    assert np.abs(image - vectors[:, there] * values[there] ** 2).max() < 1e-11 * right[0] ** 2


def test_settles_before_all_dimensions():
    steps = []
    rows = RANDOM.standard_normal((2000, 60)) * np.logspace(2, -4, 60)

    def product(q):
        steps.append(1)
        return rows.T @ (rows @ q)

    bidiagonalised(product, 60, 8)
    assert len(steps) < 50


def test_query_against_numpy(spark):
    found = op11_lanczos_whitening(spark, FOLDER).collect()
    source = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    deviations, values, projected, trace = expected(source.values())
    assert len(found) == 8 * len(source)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert {k for _, k in by} == set(range(1, 9))
    signs = {}
    for i, key in enumerate(source):
        for k in range(8):
            row = by[key, k + 1]
            right = projected[i, k] / np.sqrt(values[k])
            sign = signs.setdefault(k, np.sign(right * row["whitened"]))
            assert abs(sign * row["whitened"] - right) < 1e-8
            assert row["n"] == len(source) and row["deviation"] == deviations[i]
            assert abs(row["explained"] / (values[k] / trace) - 1) < 1e-9
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


SCHEMA = "vec_id long, embedding array<float>, n string, whitened int, place string, `\x01y` int"


def rows_of(spark, vectors):
    rows = [(i, v, "n", 1, "here", 2) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_odd_rows(spark):
    """Null and broken vectors go, copies and null ids stay, and so do further columns."""
    good = [[float(i % 5), 1.5 * (i % 3), -float(i % 2)] for i in range(30)]
    odd = [None, [None, 1.0, 1.0], [1.0, NAN, 1.0], [INF, 1.0, 1.0], [1.0, -INF, 1.0], [3e38, 1.0, 1.0], [1.0], [], [2.0] * 4]
    table = [*enumerate(good), (None, good[0]), (0, good[0]), *((100 + i, v) for i, v in enumerate(odd))]
    frame, model, error = whiten(rows_of(spark, table))
    found = frame.collect()
    assert frame.columns == ["vec_id", "place", "\x01y", "n", "deviation", "whitened"]
    ids = [r["vec_id"] for r in found]
    assert sorted(i for i in ids if i is not None) == sorted([*range(30), 0]) and ids.count(None) == 1
    deviations, values, projected, _ = expected([*good, good[0], good[0]], 3)
    for r in found:
        i = r["vec_id"] or 0
        assert r["deviation"] == Decimal(deviations[i]) and r["n"] == 32
        assert np.abs(np.abs(r["whitened"]) - np.abs(projected[i] / np.sqrt(values))).max() < 1e-9
    assert error < 1e-12 and len(model.deviations) == 3


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(i, [2.0, 3.0]) for i in range(9)]])
def test_nothing_to_tell_apart(spark, vectors):
    frame, model, _ = whiten(rows_of(spark, vectors))
    assert model is None and frame.collect() == []


def test_fewer_directions_than_components(spark):
    frame, model, error = whiten(rows_of(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]))
    assert len(model.deviations) == 1 and error < 1e-12
    assert all(len(r["whitened"]) == 1 for r in frame.collect())


def test_numbers_beyond_64_bits():
    x = np.array([[1 << 60, 5], [-(1 << 60), 7], [3, 1 << 59]])
    sums = [int(sum(map(int, c))) for c in x.T]
    centre = Centre(3, sums, 1 << 60)
    right = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert [int(d) for d in centre.deviations(x).to_pylist()] == right
    assert np.allclose(centre.centred(x), (x - np.array(sums) / 3), rtol=1e-12)
    assert Centre(10, [0, 0], 1 << 61).deviations(np.array([[1 << 61, 0]])).to_pylist() == [None]
