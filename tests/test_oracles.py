"""Every registered query against its SQL on the smallest tables."""

import pytest

from check_oracles import compare, connect
from siftwell.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.columns and df.count() > 0


def test_every_inventory_row_has_a_query():
    counts = dict(a=28, b=22, c=16, d=59, e=16, f=13, g=7, h=37, i=15, j=12, k=13, l=5)
    have = {name.split("_")[0] for name in QUERIES}
    missing = [f"{k}{i:02d}" for k, n in counts.items() for i in range(1, n + 1) if f"{k}{i:02d}" not in have]
    assert missing == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["domain", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
