"""The core's queries stand alone; a broken package of llm queries is an error, not a shorter list of queries."""

import importlib.util
import sys

import pytest

import __spark_entry__ as entry


def test_core_queries_without_the_llm_package(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "quillstream.llm" else found(name, *a))
    names = set(entry.queries())
    assert "p5_found" in names and not any(n.startswith("p1_") for n in names)


@pytest.mark.skipif(importlib.util.find_spec("quillstream.llm") is None, reason="the llm package is not installed")
def test_broken_llm_queries_fail_loudly(monkeypatch):
    monkeypatch.setitem(sys.modules, "quillstream.llm.queries", None)
    with pytest.raises(ImportError):
        entry.queries()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
