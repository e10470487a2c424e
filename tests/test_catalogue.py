"""Every catalogue query against its SQL twin."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from clickloom.plans import oracles
from clickloom.plans.queries import CATALOGUE as QUERIES
from compare import difference, register_tables
from plan_text import executed_plan

ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def engine(testdata):
    connection = duckdb.connect()
    register_tables(connection, testdata)
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_the_contract_offers_the_catalogue():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_twin(spark, testdata, engine, name):
    frame = QUERIES[name](spark, testdata)
    assert difference(frame.toPandas(), engine.execute(ORACLES[name]).df()) is None
    plan = executed_plan(frame)
    # Nothing is paired with everything, and nothing leaves the JVM.
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert node not in plan


def test_entry(spark):
    trend = contract.entry(spark)
    assert trend.columns == ["period", "order_count", "revenue"]
    assert trend.count() > 0
