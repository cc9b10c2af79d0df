import pytest
from oracle import differences

import __spark_entry__ as entry
from impactlens.plans import catalog as queries


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_match(spark, sf_dir, name):
    assert differences(spark, sf_dir, entry.queries()[name], entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
