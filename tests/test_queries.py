import pytest

from kinfold import oracle, queries
from tests.compare import same

ORACLE = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, sf_dir, duck, name):
    same(queries.queries()[name](spark, sf_dir), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(queries.queries())


def test_entry_imports_without_the_corpus_parts(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_has", lambda module: False)
    assert set(e.queries()) == set(queries.queries())
    assert set(e.oracle_sql()) == set(ORACLE)
