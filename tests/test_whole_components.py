"""Components over every edge."""

from __future__ import annotations

from fleetnet.plans import answers, views

SF = "/root/testdata/sf0.001"


def plain(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        x, y = sorted((find(e.node_from), find(e.node_to)))
        root[y] = x
    return {i: find(i) for i in root}


def test_components_over_every_edge(spark):
    edges = views.net_edge(spark, SF).collect()
    want = plain(edges)
    assert {r.node_id: r.component for r in answers.comp_connected(spark, SF).collect()} == want
    types = {(k, i): c for k in (0, 1) for i, c in plain([e for e in edges if e.etype == k]).items()}
    assert {(r.etype, r.node_id): r.component for r in answers.comp_by_type(spark, SF).collect()} == types
    got = {(r.a, r.b): r.connected for r in answers.comp_pairs_connected(spark, SF).collect()}
    nodes = [r.node_id for r in views.net_node(spark, SF).collect()]
    assert got == {(i, i + 40): i in want and want.get(i) == want.get(i + 40) for i in nodes}
