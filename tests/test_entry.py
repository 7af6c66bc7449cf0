"""The driver's contract, also without the optional parts."""

import importlib
import os
import sys

import pytest

import __spark_entry__ as entry


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lumigraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lumigraph.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    fresh = importlib.reload(entry)
    assert "search_topk" in fresh.queries() and "pipeline" not in fresh.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_broken_dependency_is_an_error(monkeypatch, tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("import lumigraph.not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    with pytest.raises(ModuleNotFoundError, match="not_there"):
        entry._optional("corpus_pipeline")


def test_flagship(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
