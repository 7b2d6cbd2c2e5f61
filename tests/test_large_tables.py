"""What keeps queries on larger tables within the driver's memory."""

from __future__ import annotations

from fleetnet.operators import spatial
from fleetnet.plans import networks, views

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_no_side_of_a_join_is_broadcast_by_a_guess(spark):
    """Small files guess small tables, whose broadcast went through the driver at 60 times sf0.1."""
    assert "Broadcast" not in planned(networks.join_hub(spark, SF))


def test_a_union_of_corridors_makes_no_pairs(spark):
    edges, rows = views.net_edge(spark, SF), networks.corridors(spark, SF)
    for df, pairs in ((networks.set_corridor_union(spark, SF), spatial.corridor_edges(rows, edges)), (networks.join_corridor_anchors(spark, SF), None)):
        assert "LeftSemi" in planned(df)
        if pairs is not None:
            assert {r.edge_id for r in df.collect()} == {r.edge_id for r in pairs.collect()}


def test_corridors_are_not_broadcast_by_a_guess(spark):
    """Nothing says how many cells a corridor makes; they meet the edges by a shuffle unless they are measured as few."""
    assert any("SortMergeJoin [gx" in line for line in planned(networks.join_corridor(spark, SF)).splitlines())


def test_rounds_do_not_multiply_the_guess_of_bytes(spark):
    """A plan's guess of its size grew with the power of the rounds, to numbers that filled the driver's memory."""
    from fleetnet.storage import cut

    rows = spark.range(9).selectExpr("id as a", "id as b")
    guess = lambda df: len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    for _ in range(4):
        rows = cut(rows.join(rows.withColumnRenamed("b", "c"), "a").select("a", "b"))
    assert guess(rows) < 25 and sorted(r.a for r in rows.collect()) == list(range(9))


def test_the_broadcast_network_is_small(spark):
    """Its arcs pass through the driver."""
    from fleetnet.operators import paths

    assert 28 * paths.MAX_ARCS <= 30_000_000


def test_arrivals_hold_no_route_unless_it_is_asked_for(spark):
    """Sums along a way are the route's, whatever blocks it goes through."""
    from fleetnet.operators import network, paths
    from fleetnet.plans import answers

    assert "route_nodes" not in answers._arrivals(spark, SF).columns
    arcs = network.arcs(views.net_edge(spark, SF))
    source, nodes = answers._source(spark), views.net_node(spark, SF)
    walkers = nodes.selectExpr("'S' as key", "cast(node_id as string) as id", "node_id", "double(47) as kmh")
    sums = {int(r.id): r for r in paths.walked_sums(paths.time_fields(source, arcs), source, walkers.join(paths.time_fields(source, arcs).select("node_id"), "node_id"), arcs, block_nodes=30).collect()}
    edge = {(r.edge_id): (r.length_m, min(47.0, r.limit_kmh) if r.limit_kmh > 0 else 47.0) for r in arcs.collect()}
    for r in paths.routes(source, nodes.selectExpr("'S' as key", "node_id as target"), arcs).collect():
        road = drive = 0.0
        for e in r.edges:
            road, drive = road + edge[e][0], drive + edge[e][0] * 3.6 / edge[e][1]
        assert (sums[r.target].exit_node, sums[r.target].road_m, sums[r.target].drive_s) == (0, road, drive)


def test_a_type_on_several_pages_has_one_row(spark, monkeypatch):
    from functools import partial

    from fleetnet.plans import extras
    from fleetnet.streaming import state

    whole = sorted(map(tuple, extras.stream_snapshot(spark, SF).collect()))
    monkeypatch.setattr(state, "map_snapshot", partial(state.map_snapshot, page=2))
    assert sorted(map(tuple, extras.stream_snapshot(spark, SF).collect())) == whole and len({r[0] for r in whole}) == len(whole)


def test_the_nearest_edge_may_lie_outside_the_cells_that_have_one(spark):
    vehicle = spark.createDataFrame([("V", "truck", 0.0001, 0.01)], "id string, vtype string, lat double, lon double")
    far, near = (1, 0.055), (2, -0.045)  # two cells reach to 0.06 north and to -0.04 south
    edges = spark.createDataFrame([(k, k * 10, k * 10 + 1, 0, 1000.0, 50.0, lat, 0.005, lat, 0.015) for k, lat in (far, near)], "edge_id bigint, node_from bigint, node_to bigint, etype int, length_m double, speed_kmh double, flat double, flon double, tlat double, tlon double")
    assert [r.edge_id for r in spatial.nearest_edge(vehicle, edges, exact=True).collect()] == [2]


def test_vehicles_near_a_pole_are_near_across_many_meridians(spark):
    rows = spark.createDataFrame([("a", "truck", 85.0, 113.0), ("b", "truck", 85.0, 113.6), ("c", "truck", 89.999, 10.0), ("d", "truck", 89.999, 170.0)], "id string, vtype string, lat double, lon double")
    got = {(r.id, r.other_id) for r in spatial.nearby_vehicles(rows, 6_000.0).collect()}
    assert got == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}


def test_short_segments_stay_where_they_are_asked_for(spark):
    from fleetnet.sources.osm import segments

    ways = spark.createDataFrame([(1, 0, 0.0, [1, 2, 3])], "way_id bigint, etype int, speed_kmh double, refs array<bigint>")
    nodes = spark.createDataFrame([(1, 89.9999, 0.0), (2, 89.9999, 0.001), (3, 89.99, 0.0)], "node_id bigint, lat double, lon double")
    assert segments(ways, nodes).count() == 1 and segments(ways, nodes, least_m=0.0).count() == 2
