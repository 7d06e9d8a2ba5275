import pytest

import __spark_entry__ as contract
from tests.oracle_check import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    verdict, _ = compare(spark, connection, FOLDER, contract.queries()[name], ORACLES[name])
    assert verdict.strip() == "ok"


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r["topic_label"] for r in rows} == {"de", "en", "es", "fr"}
