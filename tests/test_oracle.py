"""Every registered plan against its independent DuckDB SQL (sf0.001 for speed; the
harness runs the same comparison at sf0.01)."""

import pytest

from splitlens.plans import ORACLE, QUERIES
from tests.conftest import SF001
from tests.harness import compare, duck_connection


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF001)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    r = compare(spark, con, key, SF001, QUERIES[key], ORACLE[key])
    assert r["ok"], r


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, key):
    df = QUERIES[key](spark, SF001)
    assert df.count() > 0


def test_every_key_has_a_builder():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 58
