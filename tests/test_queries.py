import pytest

import __spark_entry__ as registry
from tests.comparing import differences, duck

NAMES = [name for name in registry.queries() if name not in registry.LLM_QUERIES]


@pytest.fixture(scope="module")
def tables(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_statement():
    assert set(registry.oracle_sql()) - set(registry.LLM_ORACLES) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_statement(spark, sf_dir, tables, name):
    assert differences(registry.queries()[name](spark, sf_dir), tables, registry.oracle_sql()[name]) == []


def test_entry(spark):
    assert registry.entry(spark).count() > 0
