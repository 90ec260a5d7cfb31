"""Everything but the training-data subpackage works without it."""

import importlib
import sys

import __spark_entry__ as entry


def test_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sievework.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sievework.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    importlib.reload(entry)
    names = set(entry.queries())
    assert "filter_rollup_by_source" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= names
