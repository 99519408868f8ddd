"""Every registered query of the engine against its SQL in DuckDB, on whole small tables."""

import pytest
from conftest import SF, same

from rasterloom.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert same(df, duck.sql(SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_text_operators():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent / "rasterloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read_text(), re.M), f
