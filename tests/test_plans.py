import pytest

from paralogic.plans import catalogue


@pytest.mark.parametrize("name", ["triple_f1", "triple_f1_gate", "graph_subscores"])
def test_triples_are_dealt_and_not_broadcast(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
