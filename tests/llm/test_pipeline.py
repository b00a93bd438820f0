"""The pipeline against its contracts in sequence, and the guard around this subpackage."""

import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.conftest import ROOT
from tests.llm import brute
from tests.llm.test_operators import encoding  # noqa: F401
from tidemark.llm import jaccard_join, katz, line_dedup, mixing, shared


def test_stages_one_by_one(spark, docs, rows, encoding, tmp_path):  # noqa: F811
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "drop_repeated_lines", "drop_near_copies", "mix_sources", "encode"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {d: t for d, t in rows if brute.quality(t)[-1]}

    def go(name):
        nonlocal at
        stages[name](spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        return at.collect()

    found = go("quality_rules")
    assert {r.doc_id: r.text for r in found} == left and at.columns == table.columns
    left = {d: kept for d, (_, _, kept) in brute.lines(sorted(left.items())).items()}
    found = go("drop_repeated_lines")
    assert {r.doc_id: r.text for r in found} == left and all(r.n_chars == len(r.text) for r in found)
    left = {d: left[d] for d, (_, c) in brute.components(sorted(left.items())).items() if d == c}
    found = go("drop_near_copies")
    assert {r.doc_id: r.text for r in found} == left and at.columns == table.columns
    wanted = sorted(r.doc_id for r in mixing.copies(at).collect() for _ in range(r.copies))
    found = go("mix_sources")
    assert sorted(r.doc_id for r in found) == wanted and at.columns == table.columns
    found = go("encode")
    assert sorted(r.doc_id for r in found) == wanted
    for r in found:
        assert r.ids == encoding.encode_ordinary(left[r.doc_id]) and r.ids_sha256 == brute.sha(np.array(r.ids, "<u4").tobytes())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in found)


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, table, ids in (("odd", odd, {1, None}), ("empty", empty, set())):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name))
        assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and {r.doc_id for r in found.collect()} <= ids
        at = table
        for stage, step in corpus_pipeline.STAGES[:-1]:
            at = step(spark, at, str(tmp_path))
            assert at.columns == table.columns, stage


def test_tables_go_with_their_scope(spark, docs, tmp_path, monkeypatch):
    """Whatever an operator leaves in the shared folder goes when its scope ends; the pipeline leaves its five stages."""
    monkeypatch.setattr(shared, "root", lambda spark: f"file://{tmp_path}")
    some = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 60")
    for run in (jaccard_join.link_classes, line_dedup.digest, katz.score):
        with shared.scope(spark):
            assert run(some).count() == some.count()
            assert len(list(tmp_path.iterdir())) > 1
        assert list(tmp_path.iterdir()) == []
    with pytest.raises(ZeroDivisionError), shared.scope(spark):
        shared.written(some, "some")
        raise ZeroDivisionError
    assert list(tmp_path.iterdir()) == []
    some.write.parquet(str(tmp_path / "in/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "in")).count() > 0
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == sorted(["in", *dict(corpus_pipeline.STAGES)])


def test_rest_works_without_this_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tidemark.llm'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'segments' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
        "assert set(e.oracle_sql()) <= names\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
