"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import importlib
import sys


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("meridian.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import meridian

    monkeypatch.delattr(meridian, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "meridian.llm", None)
    import __spark_entry__ as entry

    try:
        assert importlib.reload(entry).llm is None and entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
