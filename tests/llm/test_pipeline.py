from __future__ import annotations

import hashlib
import os
import subprocess
import sys

import corpus_pipeline as cp
import duckdb
import pytest

import __spark_entry__ as entry
from marquee.llm import bpe, queries
from marquee.llm.common import table
from marquee.llm.decontaminate import contaminated
from marquee.llm.near_dedup import near_duplicates
from marquee.llm.quality import quality
from marquee.llm.secrets import secrets
from tests.llm.rows import FOLDER, odd_rows

TABLES = "documents benchmark conversations".split()


def test_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLES) <= set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    folder = FOLDER.replace("0.001", "0.01")
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    frame = queries.QUERIES[name](spark, folder)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(tuple(r) for r in frame.select(*columns).collect()) == sorted(found.fetchall())


def test_stages_follow_their_operators(spark):
    """Every stage keeps exactly what its operator says of the stage before."""
    first = docs = table(spark, FOLDER, "documents")
    kept = {}
    for name, stage in cp.STAGES:
        after = stage(spark, docs, FOLDER)
        after = after.cache()
        kept[name] = {r["doc_id"]: r for r in after.collect()}
        if name != "byte_bpe":
            assert after.schema == first.schema
        before = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            wanted = {r["doc_id"] for r in quality(docs)[0].where("kept").collect()}
        elif name == "near_dedup":
            wanted = {r["doc_id"] for r in near_duplicates(docs, size=5, percent=80).where("kept").collect()}
        elif name == "decontamination":
            gone = {r["doc_id"] for r in contaminated(docs, table(spark, FOLDER, "benchmark")).collect()}
            wanted = set(before) - gone
            assert gone
        else:
            wanted = set(before)
        assert set(kept[name]) == wanted
        if name == "secret_scan":
            spans = {r["doc_id"]: r["spans"] for r in secrets(docs).collect()}
            for k, r in kept[name].items():
                assert ("[SECRET]" in r["text"]) == bool(spans[k]) or "[SECRET]" in before[k]["text"]
                assert r["n_chars"] == len(r["text"]) and (spans[k] or r == before[k])
        if name == "byte_bpe":
            ranks = bpe.ranks(cp.public_tokenizers.path("byte_bpe_50k.tiktoken"))
            for k, r in kept[name].items():
                assert bpe.decoded(bytes(r["ids"]), ranks).decode() == before[k]["text"]
                assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"]
        docs = after


def test_run_is_the_stages(spark):
    rows = {r["doc_id"]: r for r in cp.run(spark, FOLDER).collect()}
    docs = table(spark, FOLDER, "documents")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert rows == {r["doc_id"]: r for r in docs.collect()}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    docs = odd_rows(spark, empty).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES:
        after = stage(spark, docs, FOLDER)
        if name != "byte_bpe":
            assert after.schema == docs.schema
        assert (after.count() == 0) if empty else after.count() >= 1


def test_the_rest_works_without(tmp_path):
    """The entry file alone, without the subpackage and the pipeline."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "marquee", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "marquee")
    for name in os.listdir(f"{root}/marquee"):
        if name != "llm":
            os.symlink(f"{root}/marquee/{name}", tmp_path / "marquee" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    with open(f"{root}/__spark_entry__.py") as source:
        (tmp_path / "__spark_entry__.py").write_text(source.read())
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and 'pipeline' not in n and not any(x.startswith('op1') for x in n); assert set(e.oracle_sql()) <= n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_import_errors_are_not_swallowed(tmp_path):
    """A subpackage that is there but broken is an error."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    with open(f"{root}/__spark_entry__.py") as source:
        (tmp_path / "__spark_entry__.py").write_text(source.read())
    done = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True
    )
    assert done.returncode and b"no_such_module" in done.stderr
