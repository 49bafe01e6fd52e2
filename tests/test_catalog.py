import os

import pytest
from compare import difference

from framewright.plans import registry

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), SF, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
