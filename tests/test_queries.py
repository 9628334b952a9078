"""Every query of the core: against DuckDB where there is a statement, else that it gives rows."""

import pytest

from trackscope.plans import catalog

from .parity import connect, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry_point_registers_unique_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parents[1]
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            text = file.read_text()
            assert "from .llm" not in text and "from ..llm" not in text and "trackscope.llm" not in text
