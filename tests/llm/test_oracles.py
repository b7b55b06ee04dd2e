"""Queries with SQL against DuckDB over whole tables, and the registered set."""

import pytest
from compare import differences, duck

import corpus_pipeline
from advisoryspark.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), duck(sf), oracles.ORACLES[name]) == []


def test_operators_and_stages():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
