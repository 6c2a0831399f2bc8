"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import held_against_sql

from lodestone.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    mine, theirs = held_against_sql(spark, sf_dir, QUERIES[name], ORACLES[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship_pushes_columns_down(spark, sf_dir):
    plan = catalog.flagship(spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "documents.parquet" not in plan  # the postings of the query's words stand in for the texts
    assert "In(term, [eron,thing])" in plan and "struct<vec_id:bigint,embedding:array<float>>" in plan
