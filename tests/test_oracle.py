"""Every named query against its SQL on the smallest data."""

import pytest

import compare
from netlumen.plans.catalog import ORACLE, QUERIES

SLOW = {"train_detector", "detect_connections"}        # covered by test_training


@pytest.fixture(scope="session")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, sf, con, name):
    ok, text = compare.compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf)
    assert ok, text
    assert "TYPES" not in text, text


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
