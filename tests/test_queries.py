"""Every query of the plans on the smallest tables, against its DuckDB twin or for rows alone."""

import pytest
from oracle import assert_same, duck

from porelake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_as_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_package():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "porelake"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "porelake.llm" not in path.read_text(), path
