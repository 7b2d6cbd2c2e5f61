"""Searches are dealt to all tasks."""

from __future__ import annotations

from fleetnet.operators import network, paths
from fleetnet.plans import answers, views

SF = "/root/testdata/sf0.001"


def test_searches_are_dealt_by_a_stated_number_of_tasks(spark):
    """Without one their small rows all went into a single task."""
    arcs, source = network.arcs(views.net_edge(spark, SF)), answers._source(spark)
    targets = views.net_node(spark, SF).selectExpr("'S' as key", "node_id as target")
    for df in (paths.time_fields(source, arcs), paths.routes(source, targets, arcs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan

