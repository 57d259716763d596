"""Every registered query on the smallest data set, against its SQL twin if it has one."""

import pytest

import __spark_entry__ as registry

from .compare import differences, oracle_connection
from .conftest import SMALL

# The queries of this suite, without those of the optional subpackage.
OWN = set(registry._queries())
QUERIES = {name: query for name, query in registry.queries().items() if name in OWN}
TWINS = {name: sql for name, sql in registry.oracle_sql().items() if name in OWN}
WITHOUT_TWIN = {"late_model_scores", "late_model_metrics", "drift_check", "report_summary"}


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


def test_only_the_forest_has_no_twin():
    assert set(QUERIES) - set(TWINS) == WITHOUT_TWIN
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, connection, name):
    assert differences(QUERIES[name](spark, SMALL), connection, TWINS[name]) == []


@pytest.mark.parametrize("name", sorted(WITHOUT_TWIN))
def test_query_has_rows(spark, name):
    assert not QUERIES[name](spark, SMALL).isEmpty()


def test_flagship(spark):
    assert 0 < registry.entry(spark).count() <= 10


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"csv_roundtrip", "onehot_categorical",
                                                        "impute_scale_numeric"}))
def test_plan_stays_in_the_engine(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert word not in plan


def test_measures_scan_few_columns(spark):
    plan = QUERIES["revenue_by_state"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_status:string,customer_state:string,revenue:double>" in plan
    assert "EqualTo(order_status,delivered)" in plan
