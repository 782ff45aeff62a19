"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

import pytest

from checks import CHECKS, spark_query
from checks.compare import connect, difference

ORACLES = [n for n, c in CHECKS.items() if c.sql is not None]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", ORACLES)
def test_matches_oracle(name, spark, duck, sf_dir):
    got = spark_query(name)(spark, sf_dir).toPandas()
    assert difference(got, duck.execute(CHECKS[name].sql).df()) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
