"""Every core query against its SQL on the smallest tables, and that queries without SQL run."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import compare, connect

from pathweave import queries


#: Queries for words or cases that the smallest tables happen not to have; they have rows at the next size.
MAY_BE_EMPTY = {"gmt", "search_field_exact"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, data, name):
    if name in queries.SQL:
        assert compare(spark, con, queries.QUERIES[name], queries.SQL[name], data) is None
        assert con.execute(f"select count(*) from ({queries.SQL[name]})").fetchone()[0] > 0 or name in MAY_BE_EMPTY
    else:
        assert queries.QUERIES[name](spark, data).count() >= 0


def test_entry_and_removal(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    for p in Path(queries.__file__).parent.parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "pathweave.llm" not in p.read_text()
