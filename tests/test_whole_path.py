"""Routes to every node."""

from __future__ import annotations

from collections import defaultdict

from fleetnet.operators import network, paths
from fleetnet.plans import answers, views

SF = "/root/testdata/sf0.001"


def test_every_reachable_node_has_a_shortest_route(spark):
    edges = views.net_edge(spark, SF)
    field = {r.node_id: r.t_ms for r in paths.time_fields(answers._source(spark), network.arcs(edges)).collect()}  # against SQL in test_oracle
    cost = {}
    for e in edges.filter("etype = 0").collect():
        ms = int(e.length_m * 3.6e3 / (min(60.0, e.speed_kmh) if e.speed_kmh > 0 else 60.0) + 0.5)
        cost[e.edge_id, e.node_from, e.node_to] = cost[e.edge_id, e.node_to, e.node_from] = ms
    got = defaultdict(list)
    for r in answers.path_route(spark, SF).collect():
        got[r.target].append((r.hop, r.node_id, r.edge_id))
    assert set(got) == set(field) and len([t for t in got if t % 97]) > 100
    for target, steps in got.items():
        steps.sort()
        assert [s[0] for s in steps] == list(range(len(steps))) and steps[0][1] == target and steps[-1][1] == 0
        assert sum(cost[b[2], a[1], b[1]] for a, b in zip(steps, steps[1:])) == field[target]
