"""The driver's contract without the text operators."""

from __future__ import annotations

import sys

import pytest


def test_the_engine_stands_without_the_text_operators(monkeypatch):
    import __spark_entry__ as entry
    from meterlark import catalog

    whole = set(entry.queries())
    assert whole >= set(catalog.QUERIES)
    for name in [n for n in sys.modules if n.startswith("meterlark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "meterlark.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == set(catalog.QUERIES)
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.oracle_sql()) == set(catalog.SQL)
