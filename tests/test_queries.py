"""Every query of the engine against its SQL, over whole tables of the smallest size."""

import pytest

from corpuslab.plans import catalog
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dense_topk_is_a_bounded_sort(spark):
    plan = catalog.queries()["dense_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_overfetch_filters_above_the_limit(spark):
    plan = catalog.queries()["dense_filtered_overfetch"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter label") < plan.index("GlobalLimit")
