import pytest
from oracle import SMALL, same

import __spark_entry__
from quireflow.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_optional_part_may_be_missing(monkeypatch, spark):
    import builtins

    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("quireflow.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert __spark_entry__.queries() == registry.QUERIES
