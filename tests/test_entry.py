"""The driver's entry with and without the training-data operators."""

import sys

import __spark_entry__ as entry


def test_the_library_stands_without_the_training_data_operators(monkeypatch):
    for name in ("soundcheck.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it is an ImportError
    names = set(entry.queries())
    assert len(names) >= 147 and not [n for n in names if n.startswith("op") or n == "pipeline"]
    assert set(entry.oracle_sql()) <= names


def test_a_pipeline_that_cannot_be_imported_leaves_the_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(entry.queries())
    assert "pipeline" not in names and (not any(n.startswith("op") for n in names) or "op13_periodic_runs" in names)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
