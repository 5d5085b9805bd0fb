"""Every registered query against its SQL, and what its plan must not hold."""

import pytest

from checks import compare, oracles
from checks.queries import registered

FOLDER = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def base():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, base, name):
    result = registered()[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert [node for node in FORBIDDEN if node in plan] == []
    if name in oracles.all_sql():
        assert compare.difference(result, base, name) == ""
    else:
        assert result.count() >= 0


def test_every_sql_has_a_query():
    assert set(oracles.all_sql()) <= set(registered())
    assert set(registered()) == set(oracles.all_sql())
