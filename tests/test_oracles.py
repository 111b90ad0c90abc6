import __spark_entry__ as entry
import pytest

from . import oracle
from celerix.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    assert oracle.differences(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf)[:3] == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and set(entry.queries()) >= set(entry.oracle_sql())
