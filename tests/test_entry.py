import importlib
import sys


def test_entry_works_without_the_optional_part(monkeypatch):
    import builtins

    real = builtins.__import__

    def refuse(name, *args, **kw):
        if name == "corpus_pipeline" or "llm" in name:
            raise ImportError(name)
        return real(name, *args, **kw)

    for m in [m for m in sys.modules if m == "__spark_entry__" or m == "corpus_pipeline" or ".llm" in m]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", refuse)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "bm25_topk" in names and not any(n.startswith("op") for n in names) and set(entry.oracle_sql()) <= names
    monkeypatch.delitem(sys.modules, "__spark_entry__")
