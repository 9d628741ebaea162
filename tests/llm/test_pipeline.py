"""The corpus pipeline: each stage's decisions take effect; entry and queries."""
import importlib
import sys

import pytest

import corpus_pipeline as cp
from churnlens.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_dedup", "decontaminate", "mix_sources", "token_files"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        path = cp.scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            assert docs.select("text").distinct().count() == docs.count()
    assert seen[0] > seen[1] > seen[2] > seen[3] > 0 and seen[5] == seen[4]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, table if k < 4 else docs, SF)
            assert k == 4 or out.columns == table.columns
            out.count()


def test_queries_are_registered():
    import __spark_entry__ as e
    names = list(e.queries())
    assert [n for n in names if n.startswith("op")] == [n for n in queries.QUERIES] and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("gone", ["corpus_pipeline", "churnlens.llm"])
def test_the_entry_works_without_the_subpackage(gone, monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == gone:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
    saved = {k: v for k, v in sys.modules.items() if k in ("__spark_entry__", "corpus_pipeline") or k.startswith("churnlens.llm")}
    for k in saved:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    if gone == "churnlens.llm":
        import churnlens
        monkeypatch.delattr(churnlens, "llm", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "rfm_base" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    for k in [k for k in sys.modules if k in ("__spark_entry__", "corpus_pipeline") or k.startswith("churnlens.llm")]:
        monkeypatch.delitem(sys.modules, k)
    sys.modules.update(saved)
