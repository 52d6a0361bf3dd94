"""Every registered query beside its SQL on the smallest data."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from compare import differences, duck

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = [pytest.mark.slow, pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")]


@pytest.fixture(scope="module")
def tables():
    return duck(SF_DIR)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, tables, name):
    frame = contract.queries()[name](spark, SF_DIR).toPandas()
    if name in contract.oracle_sql():
        wrong = [d for d in differences(frame, tables.execute(contract.oracle_sql()[name]).df()) if not d.startswith("near")]
        assert not wrong, wrong[:3]
