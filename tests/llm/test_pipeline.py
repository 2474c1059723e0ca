"""The pipeline's stages, each against a plain-Python version on what it was given; and the registry without this subpackage."""

import builtins
import importlib
import sys

import corpus_pipeline
import pytest

from cadenza.llm import mixing, quality_rules

from .test_native import brute_hits
from .test_near_dup import brute
from .test_text_models import brute_spans


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kind, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        given = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, sf)
        rows = [r.asDict() for r in out.collect()]
        seen[name] = (given, rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == kind
        docs = spark.createDataFrame(rows, out.schema)
    (given, rows) = seen["quality rules"]
    stats = {r["doc_id"]: dict(zip(quality_rules.STATS, quality_rules.text_stats(r["text"]))) for r in given}
    passed = {i for i, s in stats.items() if s["n_words"] >= 10 and 100 * s["n_repeat_words"] <= 20 * s["n_words"]}
    kept = {r["doc_id"] for r in rows}
    assert kept <= passed and len(kept) > 0.8 * len(passed)
    (given, rows) = seen["minhash near duplicates"]
    assert {r["doc_id"] for r in rows} == {i for i, _, c, k in brute([(r["doc_id"], r["text"]) for r in given], 5, 80) if k}
    (given, rows) = seen["benchmark decontamination"]
    assert {r["doc_id"] for r in rows} == {r[0] for r in brute_hits([(r["doc_id"], r["text"]) for r in given], items) if r[2] == 0}
    (given, rows) = seen["secret scans"]
    assert len(rows) == len(given) and not any(brute_spans(r["text"]) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    before = {r["doc_id"]: r["text"] for r in given}
    assert all(r["text"] == before[r["doc_id"]] for r in rows if "[SECRET]" not in r["text"])
    (given, rows) = seen["mixing to target weights"]
    taken = {r["doc_id"]: r["copies"] for r in mixing.takes(spark.createDataFrame(given)).collect()}
    assert len(rows) == sum(taken.values()) and {r["doc_id"] for r in rows} == {i for i, n in taken.items() if n}


def test_registry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sum(k.startswith("op") for k in entry.queries()) == 10
    real = builtins.__import__

    def gone(name, *a, **k):
        if name.startswith("cadenza.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("cadenza.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", gone)
    left = importlib.reload(entry).queries()
    assert left and not any(k.startswith("op") or k == "pipeline" for k in left)


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_a_query(n):
    from cadenza.llm.queries import QUERIES

    assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1
