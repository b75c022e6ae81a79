"""Every named query with SQL gives DuckDB's rows."""

import compare
import pytest

from fieldloom.plans import measures  # noqa: F401  registers its queries
from fieldloom.plans import queries as plans


@pytest.fixture(scope="module")
def duck(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(spark, small, duck, name):
    assert compare.differences(duck, plans.ORACLE[name], plans.QUERIES[name](spark, small)) == []


def test_queries_without_sql_are_known():
    assert set(plans.QUERIES) - set(plans.ORACLE) == {"pca_scores", "pca_variance", "latent_pca", "correlation_stars", "pca_loadings", "method_axes", "axis_records"}
