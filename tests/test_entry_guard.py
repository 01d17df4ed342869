"""The entry point works where the corpus subpackage is absent, and hides no other error."""

import sys

import pytest

import __spark_entry__ as E


@pytest.mark.parametrize("gone", ["loomkit.llm", "corpus_pipeline"])
def test_missing_corpus_subpackage(monkeypatch, gone):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("loomkit.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    names = E.queries()
    assert "profile_dataset" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(E.oracle_sql()) <= set(names)


def test_other_missing_modules_are_errors(monkeypatch):
    if "corpus_pipeline" not in sys.modules:
        pytest.importorskip("corpus_pipeline")
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("loomkit.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.raises(ModuleNotFoundError):
        E.queries()
