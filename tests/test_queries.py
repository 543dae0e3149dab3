"""Every registered query against its SQL check on the small tables."""

import pytest
from compare import connect, differ

from __spark_entry__ import entry, oracle_sql, queries

SLOW = ("ml", "flow", "evl9", "smp6")
CHECKED = [n for n in queries() if n in oracle_sql()]
UNCHECKED = [n for n in queries() if n not in oracle_sql()]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, folder, con, name):
    assert differ(name, spark, folder, queries(), oracle_sql(), con) is None


@pytest.mark.parametrize("name", [n for n in UNCHECKED if not n.startswith(SLOW)])
def test_has_rows(spark, folder, name):
    assert queries()[name](spark, folder).limit(1).count() == 1


def test_entry(spark):
    out = entry(spark)
    assert out.columns == ["region", "n", "defaults", "total_cost"]
    assert sum(r.n for r in out.collect()) == 1500
