"""Every registered query outside the text operators: rows as SQL gives them, or a schema and rows where SQL can't."""

import pytest

import __spark_entry__
from lodestone.plans import all_queries as registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_are_those_of_the_sql(name, compare):
    compare(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_gives_rows(name, spark):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() > 0


def test_driver_contract(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_but_the_entry_imports_the_text_operators():
    import re
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for p in (root / "lodestone").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"lodestone\.llm|corpus_pipeline", p.read_text()), p
