"""Every registered query of the core against its SQL on the smallest tables."""

import pytest

from trainlake import queries as core

from .compare import assert_same

QUERIES, ORACLES = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
