"""The tiny road graph, random graphs against a plain search, ETL, JSON, streams and folds."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetnet import schemas
from fleetnet.functions import geo, motion, routes
from fleetnet.operators import arrivals, export, fleetops, meetings, network, paths, ranks, spatial
from fleetnet.sources import binary, osm, requests
from fleetnet.streaming import state

T0 = 1_700_000_000


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def tiny(spark):
    nodes = spark.createDataFrame([(1, 43.80, 87.50, 0), (2, 43.81, 87.51, 0), (3, 43.82, 87.52, 0)], schemas.NODE)
    edges = spark.createDataFrame([(101, 1, 2, 0, 1000.0, 72.0), (102, 2, 3, 0, 1000.0, 72.0)], schemas.EDGE)
    return nodes, network.with_ends(edges, nodes)


def fleet(spark, *rows):
    return spark.createDataFrame([(i, "truck", la, lo, 72.0, T0) for i, la, lo in rows], schemas.VEHICLE)


def pairs_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a string, b string")


def test_tiny_graph(tiny):
    nodes, edges = tiny
    assert (nodes.count(), edges.count()) == (3, 2)
    assert {r.node_id: r.degree for r in network.degrees(edges).collect()} == {1: 1, 2: 2, 3: 1}


def test_pair_meets_at_the_middle(spark, tiny):
    nodes, edges = tiny
    v = meetings.prepare(fleet(spark, ("A", 43.80, 87.50), ("B", 43.82, 87.52)), edges)
    (row,) = meetings.meetings(pairs_of(spark, ("A", "B")), v, edges, nodes).collect()
    assert row.found and abs(row.meet_s - 50) <= 2 and row.location_id == "2"
    assert abs(row.lat - 43.81) < 0.002 and abs(row.lon - 87.51) < 0.002


def test_nearest_partner_wins(spark, tiny):
    nodes, edges = tiny
    cars = fleet(spark, ("focal", 43.80, 87.50), ("near", 43.80, 87.50), ("far", 43.82, 87.52))
    found = meetings.meetings(pairs_of(spark, ("focal", "near"), ("focal", "far")), meetings.prepare(cars, edges), edges, nodes)
    order = spark.createDataFrame([("focal", 0), ("near", 1), ("far", 2)], "id string, ord int")
    (best,) = meetings.best_partner(found, order).collect()
    assert best.b == "near" and best.meet_s < 5
    ranks = {r.b: r["rank"] for r in meetings.ranked_for_lead(found).collect()}
    assert ranks == {"near": 1, "far": 2}


def test_head_start_and_no_partner(spark, tiny):
    nodes, edges = tiny
    cars = fleet(spark, ("A", 43.80, 87.50), ("B", 43.82, 87.52)).withColumn("ts_unix", F.when(F.col("id") == "A", T0 - 50).otherwise(T0).cast("bigint"))
    (row,) = meetings.meetings(pairs_of(spark, ("A", "B")), meetings.prepare(cars, edges), edges, nodes).collect()
    assert abs(row.meet_s - 25) < 2 and row.location_id == "edge:102"  # A has driven 50 s before B reports
    assert meetings.meetings(pairs_of(spark).limit(0), meetings.prepare(cars, edges), edges, nodes).count() == 0


def test_arrival_invariants(spark, tiny):
    nodes, edges = tiny
    v = meetings.prepare(fleet(spark, ("A", 43.80, 87.50), ("B", 43.81, 87.51)), edges)
    dest = spark.createDataFrame([("D", 43.82, 87.52, "truck", T0 + 3600), ("L", 43.82, 87.52, "truck", T0 + 60)], "dest_id string, lat double, lon double, vtype string, arrive_by_unix bigint")
    rows = {(r.dest_id, r.id): r for r in arrivals.ranked(arrivals.with_polylines(arrivals.arrivals(v, dest, edges, nodes), nodes)).collect()}
    assert rows["D", "A"].travel_s == pytest.approx(100) and rows["D", "A"].distance_m == pytest.approx(2000)
    assert rows["D", "B"]["rank"] == 1 and rows["D", "A"].eta_unix == T0 + rows["D", "A"].travel_s
    assert not rows["L", "A"].reachable and rows["L", "B"].reachable
    assert len(rows["D", "A"].route) == 3


def test_rest_rule(spark):
    (r,) = spark.range(1).select(motion.travel_s(F.lit(20.0 * 14_400), F.lit(20.0), F.lit("truck")).alias("a"), motion.travel_s(F.lit(20.0 * 14_399), F.lit(20.0), F.lit("truck")).alias("b"), motion.travel_s(F.lit(20.0 * 14_400), F.lit(20.0), F.lit("train")).alias("c"), motion.travel_s(F.lit(-1.0), F.lit(20.0), F.lit("truck")).alias("d")).collect()
    assert (r.a, r.b, r.c, r.d) == (16_200, 14_399, 14_400, 0)


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(42)
    edges = [(k, rng.randrange(60), rng.randrange(60), 0, rng.uniform(50, 5_000), rng.choice([0.0, 30.0, 60.0])) for k in range(110)]
    return edges, spark.createDataFrame(edges, schemas.EDGE)


def plain_search(edges, start, kmh):
    near = {}
    for k, a, b, _, length, limit in edges:
        cost = math.floor(length * 3600 / (min(kmh, limit) if limit > 0 else kmh) + 0.5)
        near.setdefault(a, []).append((b, cost))
        near.setdefault(b, []).append((a, cost))
    best, heap = {}, [(0, start)]
    while heap:
        t, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = t
        for m, c in near.get(n, []):
            heapq.heappush(heap, (t + c, m))
    return best


@pytest.mark.parametrize("engine", ["heap", "relax"])
def test_fields_equal_a_plain_search(spark, random_graph, engine):
    edges, df = random_graph
    arcs = network.arcs(df)
    sources = spark.createDataFrame([("a", 0, 0, 60.0, 0, None), ("b", 7, 0, 45.0, 0, None), ("c", 3, 0, 60.0, 0, 200_000)], "key string, node_id bigint, t_ms bigint, kmh double, etype int, horizon_ms bigint")
    got = {}
    for r in paths.time_fields(sources, arcs, engine).collect():
        got.setdefault(r.key, {})[r.node_id] = r.t_ms
    assert got["a"] == plain_search(edges, 0, 60.0) and got["b"] == plain_search(edges, 7, 45.0)
    assert got["c"] == {n: t for n, t in plain_search(edges, 3, 60.0).items() if t <= 200_000}


def test_routes_of_both_engines(spark, random_graph):
    edges, df = random_graph
    arcs = network.arcs(df)
    source = spark.createDataFrame([("a", 0, 0, 60.0, 0, None)], "key string, node_id bigint, t_ms bigint, kmh double, etype int, horizon_ms bigint")
    targets = spark.createDataFrame([("a", n) for n in (5, 11, 40, 999)], "key string, target bigint")
    one, two = ({r.target: (r.t_ms, r.nodes, r.edges) for r in paths.routes(source, targets, arcs, e).collect()} for e in ("heap", "relax"))
    assert one == two and 999 not in one
    by_id = {e[0]: e for e in edges}
    for target, (t, nodes, steps) in one.items():
        assert nodes[0] == target and nodes[-1] == 0 and len(steps) == len(nodes) - 1
        cost = sum(math.floor(by_id[k][4] * 3600 / (min(60.0, by_id[k][5]) if by_id[k][5] > 0 else 60.0) + 0.5) for k in steps)
        assert cost == t


def test_components_and_seeds(spark, random_graph):
    edges, df = random_graph
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b, *_ in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    labels = network.components(df)
    assert {r.node_id: r.component for r in labels.collect()} == {n: find(n) for n in parent}
    nodes = spark.createDataFrame([(n, float(n), 1.0, 0) for n in parent], schemas.NODE)
    for r in network.component_seeds(nodes, labels, most=3).collect():
        own = sorted(n for n in parent if find(n) == r.component)
        assert r["size"] == len(own) and list(r.seeds) == own[:3] and r.lat == pytest.approx(sum(own) / len(own))


def test_long_edges_are_found_exactly(spark):
    nodes = spark.createDataFrame([(1, 22.0, 113.0, 0), (2, 22.0, 113.5, 0)], schemas.NODE)
    edges = network.with_ends(spark.createDataFrame([(9, 1, 2, 0, 51_000.0, 0.0)], schemas.EDGE), nodes)
    car = fleet(spark, ("A", 22.01, 113.12), ("B", 23.0, 113.12))
    assert spatial.nearest_edge(car, edges).count() == 0
    (r,) = spatial.nearest_edge(car, edges, exact=True).collect()
    assert r.id == "A" and r.edge_id == 9 and abs(r.dist_m - 1112) < 5


def test_folds_equal_plain_loops(spark):
    rng = random.Random(1)
    line = [(22.0, 113.0)]
    for _ in range(30):
        line.append((line[-1][0] + rng.uniform(0, 0.01), line[-1][1] + rng.uniform(0, 0.01)))
    df = spark.createDataFrame([(line,)], f"route array<{routes.POINT}>")
    r = F.col("route")
    got = df.select(routes.length_m(r).alias("len"), routes.without_repeats(r, 700.0).alias("kept"), routes.sampled(r, routes.steps_m(r), F.lit(2_000.0)).alias("some"), routes.thinned(r, 5).alias("thin"), routes.spread_out(r, 3_000.0).alias("spread")).first()
    steps = [hav(*a, *b) for a, b in zip(line, line[1:], strict=False)]
    assert got["len"] == pytest.approx(sum(steps))
    kept = [line[0]]
    for p in line[1:]:
        if hav(*kept[-1], *p) > 700:
            kept.append(p)
    assert [tuple(p) for p in got.kept] == kept
    some, since = [line[0]], 0.0
    for i, (p, d) in enumerate(zip(line[1:], steps, strict=True)):
        since += d
        if since >= 2_000 or i == len(steps) - 1:
            some.append(p)
            since = 0.0
    assert [tuple(p) for p in got.some] == some
    assert [tuple(p) for p in got.thin] == [line[i * 30 // 4] for i in range(5)]
    spread = []
    for p in line:
        if all(hav(*q, *p) >= 3_000 for q in spread):
            spread.append(p)
    assert [tuple(p) for p in got.spread] == spread


def test_route_checks(spark):
    rows = [([(22.0, 113.0), (22.0, 113.3)], False, False), ([(22.0, 113.0), (22.0, 113.05)], True, False), ([(22.0, 113.0)], False, False), ([], False, False), ([(22.0, 113.0), (22.02, 113.02), (22.0, 113.04)], True, True)]
    df = spark.createDataFrame([(r,) for r, *_ in rows], f"route array<{routes.POINT}>")
    got = df.select(routes.sound(F.col("route")).alias("s"), routes.follows_roads(F.col("route")).alias("f")).collect()
    assert [(r.s, r.f) for r in got] == [(s, f) for _, s, f in rows]


OSM = """<osm><node id="1001" lat="43.80" lon="87.50"/><node id="1002" lat="43.81" lon="87.51"/>
<node id="1003" lat="43.82" lon="87.52"><tag k="railway" v="station"/></node><node id="5" lat="1" lon="1"/>
<way id="2001"><nd ref="1001"/><nd ref="1002"/><nd ref="1003"/><tag k="highway" v="footway"/><tag k="highway" v="primary"/><tag k="maxspeed" v="72"/></way>
<way id="2002"><nd ref="1001"/><nd ref="77"/><tag k="highway" v="primary"/></way>
<way id="2003"><nd ref="1001"/><nd ref="1002"/><tag k="highway" v="footway"/></way></osm>"""


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    nodes, edges = osm.network(spark, [str(tmp_path / "a.osm")])
    assert {r.edge_id for r in edges.collect()} == {20010000, 20010001}
    assert {r.node_id: r.kind for r in nodes.collect()} == {1001: 0, 1002: 0, 1003: 2}
    assert edges.first().speed_kmh == 72
    assert {x for r in export.point_features(nodes).collect() for x in [r.node_id]} == {1003}


def test_binary_round_trip(spark, tiny, tmp_path):
    nodes, edges = tiny
    loose = edges.unionByName(edges.limit(1).withColumns({"edge_id": F.lit(103).cast("bigint"), "node_to": F.lit(77).cast("bigint")}))
    binary.write(nodes, loose, str(tmp_path / "net.bin"))
    n, e = binary.read(spark, str(tmp_path / "net.bin"), magic="NETWORK1")
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect()))
    assert [r.edge_id for r in e.orderBy("edge_id").collect()] == [101, 102]
    with pytest.raises(Exception, match="version 1"):
        binary.read(spark, str(tmp_path / "net.bin"), magic="OTHER000")[0].count()


def test_requests(spark):
    body = '{"id":"A","lat":43.8,"lon":87.5,"speed":72,"time":"2026-06-01T10:00:00Z"}'
    rows = spark.createDataFrame([(body,), ('{"id":"B"}',), ("not json",)], "json string")
    got = requests.vehicles(rows).collect()
    assert [r.valid for r in got] == [True, False, False] and got[0].ts_unix == 1_780_308_000 and got[0].vtype == "truck"
    fleets = spark.createDataFrame([(1, f'{{"vehicles":[{body}]}}'), (2, f'{{"vehicles":[{body},{{"id":"x"}}]}}'), (3, '{"vehicles":[]}')], "request_id int, json string")
    assert {r.request_id: r.valid for r in requests.fleets(fleets).collect()} == {1: True, 2: False, 3: False}


def test_regions_prefer_provinces(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"regions":[{"suffix":"hk","name":"a","bbox":[113.8,22.1,114.6,22.6],"margin":0.05,"priority":2},{"suffix":"gd","name":"b","bbox":[109.0,20.0,117.0,25.0],"margin":0.1,"priority":40}]}')
    regions = requests.regions(spark, str(tmp_path / "r.json"))
    points = spark.createDataFrame([(22.54, 114.06), (0.0, 0.0)], "lat double, lon double")
    assert [r.region for r in spatial.region_of(points, regions).collect()] == ["gd", None]


def test_stream_state(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = "id string, seq bigint, vtype string, lat double, lon double, speed_kmh double, ts_unix bigint, history array<double>, removed boolean"
    first = [("A", 1, "truck", 1.0, 1.0, 50.0, 10, [3.0], False), ("B", 2, "truck", 1.0, 1.0, 50.0, 10, [], False)]
    then = [("A", 3, "truck", 2.0, 2.0, 60.0, 5, [], False), ("B", 4, "truck", 1.0, 1.0, 50.0, 11, [], True)]
    for k, rows in enumerate((first, then)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src / str(k)))
    seen = {}

    def answer(batch, number):
        seen.update({r.id: r for r in batch.collect()})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(src / "*"))
    q = state.answer_each_batch(stream, answer, str(out))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen["A"].lat == 2.0 and list(seen["A"].history) == [3.0]  # arrival order, and the history is kept
    assert seen["B"].removed


def test_merge_latest(spark):
    cols = "id string, seq bigint, vtype string, lat double, lon double, speed_kmh double, ts_unix bigint, history array<double>, removed boolean"
    a = spark.createDataFrame([("A", 1, "truck", 1.0, 1.0, 50.0, 10, [3.0], False), ("B", 2, "truck", 1.0, 1.0, 50.0, 10, [], False)], cols).select("id", *state._FIELDS)
    b = spark.createDataFrame([("A", 3, "truck", 2.0, 2.0, 60.0, 5, [], False), ("B", 4, "truck", 1.0, 1.0, 50.0, 11, [], True)], cols).select("id", *state._FIELDS)
    both = state.merge_latest(a, b)
    (r,) = state.present(both).collect()
    assert r.id == "A" and r.lat == 2.0 and list(r.history) == [3.0]
    old = spark.createDataFrame([("B", 3, "truck", 1.0, 1.0, 50.0, 12, [7.0], False)], cols).select("id", *state._FIELDS)
    assert [x.id for x in state.present(state.merge_latest(both, old)).collect()] == ["A"]  # an older row brings no one back
    new = spark.createDataFrame([("B", 9, "truck", 1.3, 1.0, 50.0, 12, [], False)], cols).select("id", *state._FIELDS)
    back = {x.id: x for x in state.present(state.merge_latest(state.merge_latest(both, old), new)).collect()}
    assert back["B"].seq == 9 and list(back["B"].history) == []
    changes = {x.id: (x.change, x.gx, x.old_gx) for x in state.cell_changes(both, state.merge_latest(both, new)).collect()}
    assert changes == {"B": ("insert", 5, None)}
    assert {(x.id, x.change) for x in state.cell_changes(a, both).collect()} == {("A", "move"), ("B", "remove")}


def test_round_robin_covers_cells(spark, tiny):
    nodes, edges = tiny
    b = geo.box(87.4, 43.7, 87.6, 43.9)
    assert export.round_robin(edges, b, most=1).count() == 1
    assert export.round_robin(edges, b).count() == 2


def test_write_network_and_geojson(spark, tiny, tmp_path):
    nodes, edges = tiny
    export.write_network(nodes, edges, str(tmp_path / "net"), 2)
    assert spark.read.parquet(str(tmp_path / "net/edge")).count() == 2
    export.write_geojson(export.line_features(edges), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).filter("type = 'Feature'").count() == 2


def test_empty_tables(spark, tiny):
    nodes, edges = tiny
    nobody = fleet(spark, ("A", 43.8, 87.5)).limit(0)
    assert spatial.nearest_edge(nobody, edges).count() == 0
    assert network.components(edges.limit(0)).count() == 0
    dest = spark.createDataFrame([("D", 43.82, 87.52, "truck", T0 + 3600)], "dest_id string, lat double, lon double, vtype string, arrive_by_unix bigint")
    assert arrivals.arrivals(meetings.prepare(nobody, edges), dest, edges, nodes).count() == 0


def test_mbtiles(spark, tmp_path):
    import sqlite3

    from fleetnet.sources import tiles

    for name, rows in (("base", [(1, 0, 0, b"a"), (1, 1, 1, b"b")]), ("over", [(1, 1, 1, b"c"), (2, 0, 3, b"d")])):
        with sqlite3.connect(tmp_path / f"{name}.mbtiles") as db:
            db.execute("CREATE TABLE tiles (zoom_level INT, tile_column INT, tile_row INT, tile_data BLOB)")
            db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", rows)
    base, over = (tiles.read(spark, str(tmp_path / f"{n}.mbtiles")).drop("layer") for n in ("base", "over"))
    got = {(r.z, r.x, r.y): bytes(r.data) for r in export.merged_tiles(base, over).collect()}
    assert got == {(1, 0, 1): b"a", (1, 1, 0): b"c", (2, 0, 0): b"d"}
    meta = export.tiles_meta(over).first()
    assert (meta.min_zoom, meta.max_zoom) == (1, 2)


def test_tile_caps_and_portals(spark, tiny):
    nodes, edges = tiny
    tiles = spark.createDataFrame([(0, 0, 0), (3, 0, 0)], "z int, x int, y int")
    drawn = export.tile_edges(tiles.filter("z = 3"), edges)
    assert drawn.count() == 0
    portals = spatial.nearest_nodes(spark.createDataFrame([("P", 43.80, 87.50)], "point_id string, lat double, lon double"), nodes.join(network.degrees(edges), "node_id"), 5_000.0, 2)
    assert [(r.node_id, r["rank"]) for r in portals.orderBy("rank").collect()] == [(2, 1), (1, 2)]  # degree two first


def test_field_times_and_positions(spark, random_graph):
    edges, df = random_graph
    arcs = network.arcs(df)
    source = spark.createDataFrame([("a", 0, 0, 60.0, 0, 300_000)], "key string, node_id bigint, t_ms bigint, kmh double, etype int, horizon_ms bigint")
    field = paths.time_fields(source, arcs)
    best = plain_search(edges, 0, 60.0)
    last = max(((t, -n) for n, t in best.items() if t <= 300_000))
    (r,) = paths.position_after(field).collect()
    assert (r.t_ms, r.node_id) == (last[0], -last[1])
    edge = df.filter("edge_id = 5").first()  # 0 stands for a place at a node
    place = spark.createDataFrame([("p", edge.edge_id, edge.node_from, 10.0, edge.length_m, edge.node_from, edge.node_to, 36.0)], "id string, edge_id bigint, node_id bigint, along_m double, length_m double, node_from bigint, node_to bigint, kmh double")
    want = min(best.get(edge.node_from, 1 << 60) + 1_000, best.get(edge.node_to, 1 << 60) + round((edge.length_m - 10) * 100))
    found = [r.t_ms for r in paths.times_at(paths.time_fields(source.withColumn("horizon_ms", F.lit(None).cast("bigint")), arcs), place).collect()]
    assert found == ([want] if want < 1 << 60 else [])


def test_meeting_routes(spark, tiny):
    nodes, edges = tiny
    cars = fleet(spark, ("A", 43.80, 87.50), ("B", 43.82, 87.52), ("C", 43.8201, 87.52)).withColumn("ts_unix", F.when(F.col("id") == "A", T0 - 50).otherwise(T0).cast("bigint"))
    ready = meetings.prepare(cars, edges)
    found = meetings.meetings(pairs_of(spark, ("A", "B"), ("B", "C")), ready, edges, nodes)
    rows = {(r.a, r.b): r for r in meetings.with_routes(found, ready, edges, nodes).collect()}
    ab = rows["A", "B"]
    assert [(round(p.lat, 2), round(p.lon, 2)) for p in ab.route_self[:2]] == [(43.80, 87.50), (43.81, 87.51)] and (round(ab.route_partner[0].lat, 2), ab.hops_self, ab.hops_partner) == (43.82, 1, 0)
    for r, line, m in ((ab, ab.route_self, ab.self_m), (ab, ab.route_partner, ab.partner_m)):
        assert (line[-1].lat, line[-1].lon) == (r.lat, r.lon) and m == pytest.approx(sum(hav(*p, *q) for p, q in zip(line, line[1:], strict=False)), abs=0.06)
    got = {r.a: r.json for r in export.meeting_json(meetings.with_routes(found, ready, edges, nodes)).collect()}
    assert '"routeDistanceSelfM"' in got["A"] and '"routePartner":[[' in got["A"]


def test_ranks_of_a_large_group(spark):
    rng = random.Random(13)
    rows = [("big" if rng.random() < 0.8 else rng.choice(["x", "y", None]), rng.randrange(50), k) for k in range(4_000)]
    got = ranks.ranked_within(spark.createDataFrame(rows, "g string, v int, k int").repartition(9), "g", [F.col("v"), F.col("k")]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for place, (v, k) in enumerate(sorted((v, k) for h, v, k in rows if h == g), 1):
            want[k] = place
    assert {r.k: r["rank"] for r in got} == want
    place = {r.k: (r._pos, r.n) for r in ranks.in_order(spark.createDataFrame(rows, "g string, v int, k int"), [F.col("k")], "_pos", "n").collect()}
    assert place == {k: (k, 4_000) for k in range(4_000)}
    halves = {r.g: r["median"] for r in fleetops.upper_median(spark.createDataFrame(rows, "g string, v int, k int").filter("g is not null"), "g", "v").collect()}
    assert halves == {g: sorted(v for h, v, _ in rows if h == g)[sum(h == g for h, _, _ in rows) // 2] for g in ("big", "x", "y")}


def test_arcs_without_length_end(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0, 0.0, 0.0), (2, 2, 3, 0, 0.0, 0.0), (3, 1, 3, 0, 5.0, 0.0)], schemas.EDGE)
    source = spark.createDataFrame([("a", 1, 0, 60.0, 0, None)], "key string, node_id bigint, t_ms bigint, kmh double, etype int, horizon_ms bigint")
    targets = spark.createDataFrame([("a", n) for n in (1, 2, 3)], "key string, target bigint")
    for engine in ("heap", "relax"):
        got = {r.target: list(r.nodes) for r in paths.routes(source, targets, network.arcs(edges), engine).collect()}
        assert got == {1: [1], 2: [2, 1], 3: [3, 2, 1]}


def test_blocks_of_a_network(spark, random_graph):
    edges, df = random_graph
    arcs = network.arcs(df)
    sources = spark.createDataFrame([(f"k{n}", n, 0, 60.0, 0, None) for n in range(0, 60, 13)] + [("k0", 7, 90_000, 60.0, 0, None), ("off", 999, 5, 60.0, 0, None)], "key string, node_id bigint, t_ms bigint, kmh double, etype int, horizon_ms bigint")
    own = lambda rows: sorted((r.key, r.node_id, r.t_ms) for r in rows.collect())
    small = own(paths.relaxed_fields(sources, arcs, block_nodes=7))  # nine blocks, ways go in and out of them
    assert small == sorted([*[x for x in own(paths.time_fields(sources, arcs, "heap"))], ("off", 999, 5)])
    targets = spark.createDataFrame([(f"k{n}", t) for n in range(0, 60, 13) for t in range(60)] + [("off", 999)], "key string, target bigint")
    line = lambda rows: {(r.key, r.target): (list(r.nodes), list(r.edges)) for r in rows.collect()}
    got = line(paths._walked(paths.relaxed_fields(sources, arcs, block_nodes=7), targets, arcs, block_nodes=7))
    assert got.pop(("off", 999)) == ([999], []) and got == line(paths.routes(sources, targets, arcs, "heap"))
    with pytest.raises(RuntimeError, match="isn't complete"):
        paths.relaxed_fields(sources, arcs, max_rounds=1, block_nodes=7)
