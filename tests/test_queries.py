"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    if name in ORACLES:
        assert compare(found, duck, ORACLES[name]) == ""
    else:
        assert found.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_accepted_and_rejected_add_up(spark):
    row = entry.queries()["batch_outcomes"](spark, SF).selectExpr(
        "sum(received) AS received", "sum(accepted) + sum(rejected) AS settled"
    ).first()
    assert row["received"] == row["settled"]
