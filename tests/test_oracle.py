"""Every query with SQL against DuckDB, over whole tables."""

import pytest

import __spark_entry__ as driver
from compare import differences, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(driver.queries()[name](spark, sf), con, driver.oracle_sql()[name]) == []


def test_repeated_fits_leave_nothing_behind(spark, small):
    import os

    from advisoryspark import catalog
    from advisoryspark.session import work_dir
    names = ("memm_fit", "hmm_fit", "hmm_em_step", "chronological_index", "tfidf_weights", "prev_state")
    for name in names:
        catalog.QUERIES[name](spark, small).collect()
    before = set(os.listdir(work_dir(spark)))
    for name in names:
        catalog.QUERIES[name](spark, small).collect()
    assert set(os.listdir(work_dir(spark))) == before


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    from advisoryspark import oracles

    assert set(oracles.ORACLES) <= set(driver.queries())
