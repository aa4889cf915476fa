"""The driver's contract, with and without the corpus folders."""

import sys

import __spark_entry__ as entry_module


def test_entry_has_rows(spark, sf_dir):
    assert entry_module.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_without_the_corpus_folders(monkeypatch):
    full = set(entry_module.queries())
    monkeypatch.setitem(sys.modules, "tidewater.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    rest = set(entry_module.queries())
    assert "brand_block" in rest and rest <= full
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in rest)
    assert "brand_block" in entry_module.oracle_sql()
