"""Every registered query against its SQL twin on the smallest tables; model queries by shape."""

import pytest

from check_oracle import compare, duck
from furnacelens.registry import QUERIES, SQL

SLOW_MODELS = {"j04_gradient_boosting", "j05_model_benchmark", "i12_full_ranking"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW_MODELS))
def test_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
