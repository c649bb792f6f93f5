"""Every registered query runs on empty tables (same schemas) without an error."""

import pytest

from splitlens.plans import QUERIES
from splitlens.session import shared_dir
from splitlens.sources.tables import TABLES
from tests.conftest import SF001


@pytest.fixture(scope="module")
def empty_dir(spark):
    d = shared_dir(spark, "empty-tables")
    for t in TABLES:
        spark.read.parquet(f"{SF001}/{t}.parquet").limit(0).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_runs_on_empty_tables(spark, empty_dir, key):
    df = QUERIES[key](spark, empty_dir)
    df.collect()
    assert df.columns
