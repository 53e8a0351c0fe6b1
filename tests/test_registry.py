import pytest
from oracle_check import compare, views

from lexweave import registry


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, data, con, name):
    compare(con, registry.SQL[name], registry.QUERIES[name](spark, data))


#: Queries whose right result over the smallest tables is empty, with why.
EMPTY = {"parsed_tree_issues": "trees parsed by this package have no broken invariant"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    rows = df.collect()
    if name in EMPTY:
        assert rows == []
        return
    assert rows and len(df.columns) == len(set(df.columns))
    # Every column says something, and the rows are the same when the query runs again.
    assert all(any(r[c] is not None for r in rows) for c in df.columns)
    assert sorted(map(repr, registry.QUERIES[name](spark, data).collect())) == sorted(map(repr, rows))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_core_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(registry.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lexweave.llm" not in p.read_text("utf-8"), p
