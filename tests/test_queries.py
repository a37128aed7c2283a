"""Every query with SQL against that SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from plumbline import chunk_queries, queries

QUERIES, ORACLES = queries.QUERIES | chunk_queries.QUERIES, queries.ORACLES | chunk_queries.ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module_without_llm(spark, monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("plumbline.llm", "corpus_pipeline") else real(name, *a))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    assert entry.entry(spark).count() > 0
