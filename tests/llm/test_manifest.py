"""The Merkle manifest against trees built with hashlib."""

from __future__ import annotations

import hashlib

import pytest

from marquee.llm import manifest
from marquee.llm.manifest import document_manifest
from marquee.llm.queries import op12_merkle_manifest
from tests.llm.rows import FOLDER, LOWER, crc, odd_rows

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and for each leaf its siblings before and after, level by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for path, place in zip(paths, at, strict=True):
            low = place // 16 * 16
            path.append(("".join(nodes[low:place]), "".join(nodes[place + 1 : low + 16])))
        nodes = [sha("".join(nodes[low : low + 16])) for low in range(0, len(nodes), 16)]
        at = [place // 16 for place in at]
    return nodes[0], paths


def expected(rows):
    if not rows:
        return []
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    trees = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        leaves = [((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])), r) for r in groups[source]]
        leaves.sort(key=lambda pair: pair[0])
        trees.append((leaves, *tree([key[2] for key, _ in leaves])))
    root, above = tree([subroot for _, subroot, _ in trees])
    out = []
    for (leaves, subroot, paths), upper in zip(trees, above, strict=True):
        for (key, row), path in zip(leaves, paths, strict=True):
            node, text, path = key[2], row["text"], path + upper
            if row["doc_id"] is not None and crc(row["doc_id"]) % 5 == 0:
                node = leaf(row, text and text.translate(LOWER))
            for before, after in path:
                node = sha(before + node + after)
            proof = sha("".join(before + after for before, after in path))
            out.append((row["doc_id"], key[2], subroot, root, proof, node, node == root))
    return out


def check(found, source):
    assert found.columns == COLUMNS
    rows = [tuple(r) for r in found.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, expected(source.collect())))
    return rows


def test_query(spark):
    found = check(op12_merkle_manifest(spark, FOLDER), spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    rows = odd_rows(spark, empty)
    check(document_manifest(rows), rows)


def few(spark, sizes, schema="doc_id long, source string, lang string, n_chars long, text string"):
    rows = [(7 * i, source, "en", None, f"Text {source} {i}") for source, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, "b": 1}, {None: 16, "": 17, "é": 33, "z": 2}, {"a": 256, "b": 257, "c": 15}])
def test_sizes_of_trees(spark, sizes):
    rows = few(spark, sizes)
    check(document_manifest(rows), rows)


def test_several_rounds_of_blocks(spark, monkeypatch):
    """Blocks of one digit: four rounds for the rows of one source, two for the sources."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK_BITS", manifest.BITS)
    rows = few(spark, {"hot": 4400, **{f"s{i}": i for i in range(1, 19)}})
    check(document_manifest(rows), rows)


def test_one_id_on_all_rows(spark):
    """Leaves decide the order of equal ids; equal leaves are interchangeable."""
    rows = few(spark, {"a": 40}).selectExpr("CAST(5 AS LONG) AS doc_id", "source", "lang", "n_chars", "text")
    rows = rows.unionAll(rows)
    check(document_manifest(rows), rows)


def test_proofs_need_no_join(spark):
    """Rows meet in joins only where they are ranked, with a row per partition and source."""
    plan = document_manifest(few(spark, {"a": 300, "b": 3}))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "posexplode" in plan
