import pytest
from celerix.llm import registry

from .. import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, sf, name):
    assert oracle.differences(spark, con, registry.queries()[name], registry.oracle_sql()[name], sf)[:3] == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"pipeline"}))
def test_query_covers_its_table(spark, sf, name):
    whole = spark.read.parquet(f"{sf}/{'pages' if name.startswith('op6') else 'documents'}.parquet").count()
    assert registry.queries()[name](spark, sf).count() == whole
