"""Every registered query against the independent engine."""

from __future__ import annotations

import pytest
from conftest import TESTDATA

from __spark_entry__ import entry, oracle_sql, queries
from biotrace.checks.compare import connect, difference
from biotrace.checks.registry import QUERIES

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_each_query_has_a_statement():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, engine, name):
    assert difference(engine, oracle_sql()[name], queries()[name](spark, SF_DIR)) == ""


def test_entry(spark):
    assert entry(spark).columns == [
        "patientid",
        "hypoglycemic_incidents",
        "hyperglycemic_incidents",
    ]
