"""Every registered query of the engine against its SQL."""

import pytest

from siftwell import registry
from tests.compare import assert_same, expected


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLES:
        assert_same(got, expected(registry.ORACLES[name], sf_dir))
    else:
        assert len(got.columns) > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
