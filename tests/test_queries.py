"""Every query with a SQL twin gives its rows, and every query runs, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import compare  # noqa: E402

from tessaline.plans import catalog  # noqa: E402

REGISTRY = catalog.registry()


@pytest.fixture(scope="module")
def duck(base):
    return compare.oracle(base)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(name, spark, base, duck):
    df = REGISTRY.queries[name](spark, base)
    got = compare.rows(df.columns, df.collect())
    if name in REGISTRY.sql:
        res = duck.sql(REGISTRY.sql[name])
        assert sorted(res.columns) == sorted(df.columns)
        assert got == compare.rows(res.columns, res.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
