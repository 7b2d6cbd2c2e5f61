"""Queries over the network's answers: fields, routes, components, meetings and arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetnet.functions import motion
from fleetnet.functions.geo import haversine_m
from fleetnet.operators import arrivals, export, fleetops, meetings, network, paths, spatial
from fleetnet.plans import views
from fleetnet.plans.networks import ARC, CELL, SNAP
from fleetnet.plans.registry import query
from fleetnet.plans.scalars import DEST_SQL, destinations
from fleetnet.plans.views import hav, with_views


def _ms(meters: str, kmh: str) -> str:
    return f"CAST(floor(({meters}) * 3.6e3 / ({kmh}) + 5e-1) AS BIGINT)"


def _limited(kmh: str, limit: str = "limit_kmh") -> str:
    return f"CASE WHEN {limit} > 0e0 THEN least({kmh}, {limit}) ELSE {kmh} END"


def field_sql(seed: str, arc: str) -> str:
    """A recursive common table f(key, node_id, t_ms): least times from the rows of ``seed`` over ``arc`` (key, from, to, cost)."""
    return f"""f(key, node_id, t_ms) USING KEY (key, node_id) AS (SELECT key, node_id, min(t_ms) FROM {seed} GROUP BY key, node_id UNION
        SELECT f.key, w.node_to, min(f.t_ms + w.cost_ms) FROM f JOIN {arc} w ON w.node_from = f.node_id AND w.key = f.key LEFT JOIN recurring.f AS r ON r.node_id = w.node_to AND r.key = f.key
        WHERE (r.t_ms IS NULL OR f.t_ms + w.cost_ms < r.t_ms) AND f.t_ms + w.cost_ms <= w.horizon_ms GROUP BY f.key, w.node_to)"""


def _with_field(body: str, *names: str, after: dict[str, str] | None = None, **extra: str) -> str:
    """A query over f, from tables seed and w among ``extra``; ``after``: tables that are in terms of f."""
    marker = "SELECT /*body*/ 1"
    head = with_views(marker, *names, recursive=True, **extra)
    later = "".join(f", {n} AS ({q})" for n, q in (after or {}).items())
    return head.replace(f" {marker}", f", {field_sql('seed', 'w')}{later} {body}")


_W60 = f"SELECT 'S' AS key, node_from, node_to, edge_id, {_ms('length_m', _limited('6e1'))} AS cost_ms, CAST(4611686018427387904 AS BIGINT) AS horizon_ms FROM arc WHERE etype = 0"
_SEED0 = "SELECT 'S' AS key, CAST(0 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS t_ms"


def _source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("S", 0, 0, 60.0, 0, None)], "key string, node_id bigint, t_ms bigint, kmh double, etype int, horizon_ms bigint")


@query(_with_field("SELECT node_id, t_ms FROM f", "net_edge", arc=ARC, w=_W60, seed=_SEED0))
def path_time_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.time_fields(_source(spark), network.arcs(views.net_edge(spark, sf_dir))).select("node_id", "t_ms")


_SPEEDS = "SELECT id AS key, CASE WHEN vtype = 'train' THEN 1 ELSE 0 END AS etype, speed_kmh AS kmh, CAST(600000 AS BIGINT) AS horizon_ms FROM fleet"
_WV = f"SELECT key, node_from, node_to, edge_id, {_ms('length_m', _limited('kmh'))} AS cost_ms, horizon_ms FROM arc JOIN speeds ON speeds.etype = arc.etype"
_SEEDV = f"SELECT id AS key, node_id, CAST(0 AS BIGINT) AS t_ms FROM snap WHERE edge_id = 0 UNION ALL SELECT id, node_from, {_ms('along_m', 'kmh')} FROM snap JOIN speeds ON key = id WHERE edge_id <> 0 UNION ALL SELECT id, node_to, {_ms('greatest(length_m - along_m, 0e0)', 'kmh')} FROM snap JOIN speeds ON key = id WHERE edge_id <> 0"


@query(_with_field("SELECT key, node_id, t_ms FROM f", "net_edge", "fleet", arc=ARC, cell=CELL, snap=SNAP, speeds=_SPEEDS, seed=_SEEDV, w=_WV))
def path_fleet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vehicle's field within ten minutes, from where it is on its edge."""
    edges, fleet = views.net_edge(spark, sf_dir), views.fleet(spark, sf_dir)
    places = spatial.nearest_edge(fleet, edges).join(fleet.select("id", F.col("speed_kmh").alias("kmh"), motion.edge_type(F.col("vtype")).alias("etype")), "id")
    sources = paths.seeds(places).join(places.select("id", "kmh", "etype"), "id").select(F.col("id").alias("key"), "node_id", "t_ms", "kmh", "etype", F.lit(600_000).cast("bigint").alias("horizon_ms"))
    return paths.time_fields(sources, network.arcs(edges)).select("key", "node_id", "t_ms")


@query(_with_field("SELECT node_id, parent_node, parent_edge FROM (SELECT f.node_id, w.node_to AS parent_node, w.edge_id AS parent_edge, row_number() OVER (PARTITION BY f.node_id ORDER BY w.node_to, w.edge_id) AS r FROM f JOIN w ON w.node_from = f.node_id JOIN f g ON g.node_id = w.node_to WHERE g.t_ms + w.cost_ms = f.t_ms) WHERE r = 1", "net_edge", arc=ARC, w=_W60, seed=_SEED0))
def path_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = network.arcs(views.net_edge(spark, sf_dir))
    return paths.field_parents(paths.time_fields(_source(spark), arcs), arcs).select("node_id", "parent_node", "parent_edge")


_PARENT = "SELECT * FROM (SELECT f.key, f.node_id, w.node_to AS parent_node, w.edge_id AS parent_edge, row_number() OVER (PARTITION BY f.key, f.node_id ORDER BY w.node_to, w.edge_id) AS r FROM f JOIN w ON w.node_from = f.node_id AND w.key = f.key JOIN f g ON g.node_id = w.node_to AND g.key = f.key WHERE g.t_ms + w.cost_ms = f.t_ms) WHERE r = 1"
_WALK0 = "SELECT key, node_id AS target, node_id AS pos, CAST(0 AS BIGINT) AS hop, CAST(NULL AS BIGINT) AS edge_id FROM f"


@query(_with_field("SELECT target, hop, pos AS node_id, edge_id FROM walk", "net_edge", arc=ARC, w=_W60, seed=_SEED0, after={"parent": _PARENT, "walk(key, target, pos, hop, edge_id)": f"{_WALK0} UNION ALL SELECT walk.key, target, parent_node, hop + 1, parent_edge FROM walk JOIN parent ON parent.node_id = walk.pos AND parent.key = walk.key"}))
def path_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes to every node, step by step."""
    targets = views.net_node(spark, sf_dir).select(F.lit("S").alias("key"), F.col("node_id").alias("target"))
    r = paths.routes(_source(spark), targets, network.arcs(views.net_edge(spark, sf_dir)))
    steps = r.select("target", "edges", F.posexplode("nodes").alias("hop", "node_id"))
    return steps.select("target", F.col("hop").cast("bigint").alias("hop"), "node_id", F.when(F.col("hop") > 0, F.get("edges", F.col("hop") - 1)).alias("edge_id"))


def _component_sql(body: str, where: str = "TRUE") -> str:
    """``body`` over c(etype, node_id, comp), components over the edges of each group: etype, or 0 for all."""
    link = f"SELECT CAST(0 AS BIGINT) AS g, node_from AS a, node_to AS b FROM net_edge WHERE {where}"
    return _grouped_components(link, body)


def _grouped_components(link: str, body: str) -> str:
    both = f"{link} UNION ALL SELECT g, b, a FROM ({link})"
    c = "c(g, node_id, comp) USING KEY (g, node_id) AS (SELECT DISTINCT g, a, a FROM link UNION SELECT link.g, link.b, min(c.comp) FROM c JOIN link ON link.a = c.node_id AND link.g = c.g JOIN recurring.c AS r ON r.node_id = link.b AND r.g = link.g WHERE c.comp < r.comp GROUP BY link.g, link.b)"
    return with_views("SELECT 1", "net_edge", recursive=True, link=both).replace(" SELECT 1", f", {c}{body}")


#: The fast network, which falls into several components.
_FAST = "speed_kmh >= 6e1"


@query(_component_sql(" SELECT node_id, comp AS component FROM c"))
def comp_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over every edge: the hard case, one that holds the whole table."""
    return network.components(views.net_edge(spark, sf_dir))


@query(_grouped_components("SELECT CAST(etype AS BIGINT) AS g, node_from AS a, node_to AS b FROM net_edge", " SELECT CAST(g AS INTEGER) AS etype, node_id, comp AS component FROM c"))
def comp_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over the edges of each type: several, by a real attribute."""
    edges = views.net_edge(spark, sf_dir)
    one = lambda k: network.components(edges.filter(F.col("etype") == k)).withColumn("etype", F.lit(k))
    return one(motion.ROAD).unionByName(one(motion.RAIL))


_PAIRS_SQL = " SELECT n.node_id AS a, n.node_id + 40 AS b, x.comp IS NOT NULL AND y.comp IS NOT NULL AND x.comp = y.comp AS connected FROM net_node n LEFT JOIN c x ON x.node_id = n.node_id LEFT JOIN c y ON y.node_id = n.node_id + 40"


def _pairs_connected(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    pairs = views.net_node(spark, sf_dir).select(F.col("node_id").alias("a"), (F.col("node_id") + 40).alias("b"))
    return network.connected(pairs, network.components(edges)).select("a", "b", "connected")


@query(_component_sql(_PAIRS_SQL))
def comp_pairs_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each node and the one north of it are in one component over every edge."""
    return _pairs_connected(spark, sf_dir, views.net_edge(spark, sf_dir))


@query(_component_sql(_PAIRS_SQL, _FAST))
def comp_pairs_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the edges with a limit of 60 km/h or more."""
    return _pairs_connected(spark, sf_dir, views.net_edge(spark, sf_dir).filter("speed_kmh >= 60"))


@query(_component_sql(f""", loc AS MATERIALIZED (SELECT c.node_id, comp, lat, lon, count(*) OVER (PARTITION BY comp) AS n FROM c JOIN net_node USING (node_id)) SELECT component, node_from, node_to, length_m FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY length_m, node_from, node_to) AS r FROM (
    SELECT a.comp AS component, a.node_id AS node_from, b.node_id AS node_to, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS length_m FROM loc a JOIN loc b ON a.comp <> b.comp AND abs(a.lat - b.lat) < 5e-2 WHERE a.n <= 48) WHERE length_m <= 5e3) WHERE r = 1""", _FAST))
def comp_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each small component of the fast network the shortest way to another one."""
    labels = network.components(views.net_edge(spark, sf_dir).filter("speed_kmh >= 60"))
    return network.bridges(views.net_node(spark, sf_dir), labels, reach_m=5_000.0, size=0.02)


@query(_component_sql(" SELECT comp AS component, count(*) AS size, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, CAST(least(24, count(*)) AS INTEGER) AS n_seeds, list_sum(list_slice(list_sort(list(node_id)), 1, 24)) AS seed_sum FROM c JOIN net_node USING (node_id) GROUP BY comp", _FAST))
def comp_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, centroid and first nodes of each component of the fast network."""
    labels = network.components(views.net_edge(spark, sf_dir).filter("speed_kmh >= 60"))
    c = network.component_seeds(views.net_node(spark, sf_dir), labels)
    return c.select("component", "size", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.size("seeds").alias("n_seeds"), F.aggregate("seeds", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("seed_sum"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = views.fleet(spark, sf_dir)
    history = views.ping(spark, sf_dir).join(fleet.select("id", "s_suppkey"), F.col("vehicle") == F.col("s_suppkey")).select("id", "speed_kmh")
    return meetings.prepare(meetings.history_speeds(fleet, history), views.net_edge(spark, sf_dir))


#: Vehicles on the network with their fused speed.
PREP = """SELECT v.*, s.edge_id, s.node_id, s.along_m, s.node_from, s.node_to, s.length_m, CASE WHEN v.vtype = 'train' THEN 1 ELSE 0 END AS etype,
    round(greatest(CASE WHEN s.edge_id <> 0 AND s.limit_kmh > 0e0 THEN least(k, s.limit_kmh) ELSE k END, 1e0), 9) AS kmh
    FROM (SELECT fleet.*, CASE WHEN coalesce(h, 0e0) > 0e0 THEN h * 8.5e-1 + fleet.speed_kmh * (1 - 8.5e-1) ELSE fleet.speed_kmh END AS k FROM fleet LEFT JOIN (SELECT vehicle, round(avg(speed_kmh), 11) AS h FROM ping GROUP BY vehicle) p ON vehicle = s_suppkey) v JOIN snap s ON s.id = v.id"""


@query(with_views("SELECT id, edge_id, node_id, round(kmh, 9) AS kmh FROM prep", "net_edge", "fleet", "ping", cell=CELL, snap=SNAP, prep=PREP))
def match_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("id", "edge_id", "node_id", F.round("kmh", 9).alias("kmh"))


def _meet_sql(pairs: str, body: str, **more: str) -> str:
    """Meetings of ``pairs`` (a, b), as rows of best(a, b, t0, found, t, kind, place, s); ``more``: tables in terms of it."""
    reach = f"""SELECT a.id AS a, b.id AS b, greatest(a.ts_unix, b.ts_unix) AS t0, a.ts_unix AS tsa, b.ts_unix AS tsb, a.kmh AS ka, b.kmh AS kb, a.etype,
        CAST(floor(least(1.728e5, greatest(4.8e2, d / greatest(5e0, least(a.kmh / 3.6e0, b.kmh / 3.6e0)) * 1.35e0 + 2.4e2)) * 1000) AS BIGINT) AS horizon_ms
        FROM (SELECT p.a AS pa, p.b AS pb, round({hav('x.lat', 'x.lon', 'y.lat', 'y.lon')}, 3) AS d FROM ({pairs}) p JOIN prep x ON x.id = p.a JOIN prep y ON y.id = p.b) JOIN prep a ON a.id = pa JOIN prep b ON b.id = pb
        WHERE a.vtype = b.vtype AND d <= (a.kmh / 3.6e0 + b.kmh / 3.6e0) * 1.728e5 * 5.5e-1 + 5e3"""
    need = "SELECT key, max(h) AS horizon_ms FROM (SELECT a AS key, horizon_ms + (t0 - tsa) * 1000 AS h FROM reach UNION ALL SELECT b, horizon_ms + (t0 - tsb) * 1000 FROM reach) GROUP BY key"
    seed = f"SELECT id AS key, node_id, CAST(0 AS BIGINT) AS t_ms FROM prep JOIN need ON key = id WHERE edge_id = 0 UNION ALL SELECT id, node_from, {_ms('along_m', 'kmh')} FROM prep JOIN need ON key = id WHERE edge_id <> 0 UNION ALL SELECT id, node_to, {_ms('greatest(length_m - along_m, 0e0)', 'kmh')} FROM prep JOIN need ON key = id WHERE edge_id <> 0"
    w = f"SELECT need.key, arc.node_from, arc.node_to, arc.edge_id, {_ms('arc.length_m', _limited('kmh'))} AS cost_ms, need.horizon_ms FROM arc JOIN prep ON prep.etype = arc.etype JOIN need ON need.key = prep.id"
    mutual = "SELECT * FROM (SELECT r.*, fa.node_id, CAST(greatest(fa.t_ms + (tsa - t0) * 1000, 0) AS DOUBLE) AS ua, CAST(greatest(fb.t_ms + (tsb - t0) * 1000, 0) AS DOUBLE) AS ub FROM reach r JOIN f fa ON fa.key = r.a JOIN f fb ON fb.key = r.b AND fb.node_id = fa.node_id) WHERE ua <= horizon_ms AND ub <= horizon_ms"
    edge = "SELECT m.a, m.b, m.t0, e.edge_id, e.length_m AS l, 3.6e3 / m.ka AS pa, 3.6e3 / m.kb AS pb, m.ua AS a0, n.ua AS a1, m.ub AS b0, n.ub AS b1 FROM mutual m JOIN net_edge e ON e.node_from = m.node_id AND e.etype = m.etype JOIN mutual n ON n.a = m.a AND n.b = m.b AND n.node_id = e.node_to"
    spot = "SELECT *, unnest([0e0, l, greatest(0e0, least(l, (b1 - a0 + l * pb) / (pa + pb))), greatest(0e0, least(l, (a1 - b0 + l * pa) / (pb + pa)))]) AS s FROM edge"
    cand = "SELECT a, b, round(greatest(ua, ub), 3) AS t, 0 AS kind, node_id AS place, 0e0 AS s FROM mutual UNION ALL SELECT a, b, round(greatest(least(a0 + s * pa, a1 + (l - s) * pa), least(b0 + s * pb, b1 + (l - s) * pb)), 3), 1, edge_id, round(s, 3) FROM spot"
    best = "SELECT r.a, r.b, r.t0, c.t, c.kind, c.place, c.s FROM reach r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY t, kind, place, s) AS k FROM cand) c ON c.a = r.a AND c.b = r.b AND c.k = 1"
    return _with_field(body, "net_edge", "fleet", "ping", arc=ARC, cell=CELL, snap=SNAP, prep=PREP, reach=reach, need=need, seed=seed, w=w, after={"mutual": mutual, "edge": edge, "spot": spot, "cand": cand, "best": best, **more})


_EVERY = "SELECT x.id AS a, y.id AS b FROM fleet x JOIN fleet y ON x.s_suppkey < y.s_suppkey AND x.vtype = y.vtype"
_LEAD = "SELECT x.id AS a, y.id AS b FROM fleet x JOIN fleet y ON x.id <> y.id WHERE x.s_suppkey = 1"
_FOCAL = "SELECT x.id AS a, y.id AS b FROM fleet x JOIN fleet y ON x.id <> y.id WHERE x.s_suppkey % 100 = 1"


def _every_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two vehicles of a type once: what is asked for is a row for each pair within the operator's reach."""
    fleet = views.fleet(spark, sf_dir)
    side = lambda k: fleet.select(F.col("id").alias(k), F.col("s_suppkey").alias(f"_{k}"), "vtype")
    return side("a").join(side("b"), "vtype").filter("_a < _b").select("a", "b")


def _lead_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = views.fleet(spark, sf_dir)
    return fleet.filter("s_suppkey <> 1").select(F.col("id").alias("b")).crossJoin(F.broadcast(fleet.filter("s_suppkey = 1").select(F.col("id").alias("a")))).select("a", "b")  # one row


def _focal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focal vehicles, a stated query set, against all others: both directions, and no radius but the operator's reach."""
    fleet = views.fleet(spark, sf_dir)
    focal = fleet.filter("s_suppkey % 100 = 1").select(F.col("id").alias("a"))
    return fleet.select(F.col("id").alias("b")).join(F.broadcast(focal), F.col("a") != F.col("b"))  # few queries


_SHOW = "SELECT a, b, t IS NOT NULL AS found, round(t / 1000, 6) AS meet_s, CASE kind WHEN 0 THEN CAST(place AS VARCHAR) WHEN 1 THEN concat('edge:', CAST(place AS VARCHAR)) END AS location_id FROM best"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("a", "b", "found", F.round("meet_s", 6).alias("meet_s"), "location_id", *more)


def _meetings(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    return meetings.meetings(pairs, _prepared(spark, sf_dir), views.net_edge(spark, sf_dir), views.net_node(spark, sf_dir))


def _routed(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    return meetings.with_routes(found, _prepared(spark, sf_dir), views.net_edge(spark, sf_dir), views.net_node(spark, sf_dir))


@query(_meet_sql(_EVERY, _SHOW))
def meet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings of all vehicles of a type."""
    return _shown(_meetings(spark, sf_dir, _every_pair(spark, sf_dir)))


@query(_meet_sql(_LEAD, f"SELECT a, b, found, meet_s, location_id, CAST(row_number() OVER (PARTITION BY a ORDER BY found DESC, t, b) AS INTEGER) AS rank FROM (SELECT *, t IS NOT NULL AS found, round(t / 1000, 6) AS meet_s, CASE kind WHEN 0 THEN CAST(place AS VARCHAR) WHEN 1 THEN concat('edge:', CAST(place AS VARCHAR)) END AS location_id FROM best)"))
def meet_lead_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vehicle against all others of its type, ranked by wait."""
    return _shown(meetings.ranked_for_lead(_meetings(spark, sf_dir, _lead_pairs(spark, sf_dir))), "rank")


_SOONEST = "SELECT a, b, t0, t, kind, place, s FROM (SELECT best.*, row_number() OVER (PARTITION BY best.a ORDER BY round(t0 + t / 1000, 6), s_suppkey) AS k FROM best JOIN fleet ON fleet.id = best.b WHERE t IS NOT NULL) WHERE k = 1"


def _soonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = views.fleet(spark, sf_dir).select("id", F.col("s_suppkey").alias("ord"))
    return meetings.soonest(_focal_pairs(spark, sf_dir), _prepared(spark, sf_dir), views.net_edge(spark, sf_dir), views.net_node(spark, sf_dir), order)


@query(_meet_sql(_FOCAL, f"SELECT a, b, round(t / 1000, 6) AS meet_s FROM ({_SOONEST})"))
def meet_best_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each focal vehicle's soonest partner among all others of its type; of equal times the first in the fleet's order."""
    return _soonest(spark, sf_dir).select("a", "b", F.round("meet_s", 6).alias("meet_s"))


def _route_sql(pairs: str, body: str, chosen: str = "SELECT a, b, t0, t, kind, place, s FROM best WHERE t IS NOT NULL") -> str:
    """Ways to meetings as rows of way(a, b, side, len, hops), the polylines' lengths; ``chosen``: the meetings."""
    spot = f"SELECT c.*, round(coalesce(n.lat, e.flat + (e.tlat - e.flat) * (s / e.length_m)), 6) AS mlat, round(coalesce(n.lon, e.flon + (e.tlon - e.flon) * (s / e.length_m)), 6) AS mlon, e.node_from, e.node_to, e.length_m AS el FROM ({chosen}) c LEFT JOIN net_node n ON c.kind = 0 AND n.node_id = c.place LEFT JOIN net_edge e ON c.kind = 1 AND e.edge_id = c.place"
    ends = "SELECT *, place AS target, 0e0 AS off FROM mspot WHERE kind = 0 UNION ALL SELECT *, node_from, abs(s) FROM mspot WHERE kind = 1 UNION ALL SELECT *, node_to, abs(s - el) FROM mspot WHERE kind = 1"
    goal = "SELECT 'self' AS side, a AS id, * FROM mend UNION ALL SELECT 'partner', b, * FROM mend"
    pick = "SELECT * FROM (SELECT g.*, p.lat AS vlat, p.lon AS vlon, row_number() OVER (PARTITION BY g.a, g.b, side ORDER BY round(f.t_ms + off * 3.6e3 / p.kmh, 3), target) AS r FROM goal g JOIN prep p ON p.id = g.id JOIN f ON f.key = g.id AND f.node_id = target) WHERE r = 1"
    parent = "SELECT * FROM (SELECT f.key, f.node_id, w.node_to AS parent_node, row_number() OVER (PARTITION BY f.key, f.node_id ORDER BY w.node_to, w.edge_id) AS r FROM f JOIN w ON w.node_from = f.node_id AND w.key = f.key JOIN f g ON g.node_id = w.node_to AND g.key = f.key WHERE g.t_ms + w.cost_ms = f.t_ms AND NOT EXISTS (SELECT 1 FROM seed s WHERE s.key = f.key AND s.node_id = f.node_id AND s.t_ms = f.t_ms)) WHERE r = 1"
    first = f"SELECT pick.a, pick.b, side, id, vlat, vlon, target AS pos, 0 AS hops, CASE WHEN {hav('n.lat', 'n.lon', 'mlat', 'mlon')} > 1e0 THEN {hav('n.lat', 'n.lon', 'mlat', 'mlon')} ELSE 0e0 END AS len FROM pick JOIN net_node n ON n.node_id = target"
    steps = f"SELECT walk.a, walk.b, side, id, vlat, vlon, parent_node, hops + 1, len + {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} FROM walk JOIN parent ON parent.key = walk.id AND parent.node_id = walk.pos JOIN net_node x ON x.node_id = parent_node JOIN net_node y ON y.node_id = walk.pos"
    way = f"SELECT walk.a, walk.b, side, walk.hops, round(len + CASE WHEN {hav('vlat', 'vlon', 'n.lat', 'n.lon')} > 2.5e1 THEN {hav('vlat', 'vlon', 'n.lat', 'n.lon')} ELSE 0e0 END, 1) AS len FROM walk JOIN net_node n ON n.node_id = pos LEFT JOIN parent ON parent.key = walk.id AND parent.node_id = walk.pos WHERE parent.key IS NULL"
    return _meet_sql(pairs, body, mspot=spot, mend=ends, goal=goal, pick=pick, parent=parent, **{"walk(a, b, side, id, vlat, vlon, pos, hops, len)": f"{first} UNION ALL {steps}"}, way=way)


@query(_route_sql(_LEAD, "SELECT best.a, best.b, best.t IS NOT NULL AS found, x.len AS self_m, y.len AS partner_m, x.hops AS hops_self, y.hops AS hops_partner FROM best LEFT JOIN way x ON x.a = best.a AND x.b = best.b AND x.side = 'self' LEFT JOIN way y ON y.a = best.a AND y.b = best.b AND y.side = 'partner'"))
def meet_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead's and its partners' ways to where they meet: lengths of the polylines and edges in full."""
    found = _routed(spark, sf_dir, _meetings(spark, sf_dir, _lead_pairs(spark, sf_dir)))
    return found.select("a", "b", "found", "self_m", "partner_m", "hops_self", "hops_partner")


def _arrive_sql(body: str) -> str:
    """Arrivals as rows of arrive(dest_id, id, reachable, travel_s, eta_unix, distance_m)."""
    snap = SNAP.replace("FROM fleet v", "FROM (SELECT dest_id AS id, dlat AS lat, dlon AS lon, dtype AS vtype FROM dest) v")
    seed = f"SELECT id AS key, node_id, CAST(0 AS BIGINT) AS t_ms, 0e0 AS goal_m FROM gsnap WHERE edge_id = 0 UNION ALL SELECT id, node_from, {_ms('along_m', '8e1')}, along_m FROM gsnap WHERE edge_id <> 0 UNION ALL SELECT id, node_to, {_ms('greatest(length_m - along_m, 0e0)', '8e1')}, greatest(length_m - along_m, 0e0) FROM gsnap WHERE edge_id <> 0"
    w = f"SELECT dest_id AS key, node_from, node_to, edge_id, {_ms('length_m', _limited('8e1'))} AS cost_ms, CAST(4611686018427387904 AS BIGINT) AS horizon_ms, length_m, limit_kmh FROM arc JOIN dest ON arc.etype = CASE WHEN dtype = 'train' THEN 1 ELSE 0 END"
    entry = "SELECT id, node_id, 0e0 AS off_m FROM prep WHERE edge_id = 0 UNION ALL SELECT id, node_from, along_m FROM prep WHERE edge_id <> 0 UNION ALL SELECT id, node_to, greatest(length_m - along_m, 0e0) FROM prep WHERE edge_id <> 0"
    start = f"SELECT * FROM (SELECT dest_id, p.id, p.ts_unix, p.kmh, p.vtype, arrive_by_unix, e.node_id, e.off_m, row_number() OVER (PARTITION BY dest_id, p.id ORDER BY f.t_ms + {_ms('e.off_m', '8e1')}, e.node_id) AS r FROM prep p JOIN dest ON dtype = p.vtype AND p.ts_unix < arrive_by_unix JOIN entry e ON e.id = p.id JOIN f ON f.key = dest_id AND f.node_id = e.node_id) WHERE r = 1"
    parent = "SELECT * FROM (SELECT f.key, f.node_id, w.node_to AS parent_node, w.length_m, w.limit_kmh, row_number() OVER (PARTITION BY f.key, f.node_id ORDER BY w.node_to, w.edge_id) AS r FROM f JOIN w ON w.node_from = f.node_id AND w.key = f.key JOIN f g ON g.node_id = w.node_to AND g.key = f.key WHERE g.t_ms + w.cost_ms = f.t_ms) WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM seed s JOIN f h ON h.key = s.key AND h.node_id = s.node_id WHERE s.key = parent_key AND s.node_id = parent_from AND s.t_ms = h.t_ms)"
    parent = parent.replace("SELECT * FROM (SELECT f.key,", "SELECT * FROM (SELECT f.key AS parent_key, f.node_id AS parent_from, f.key,")
    walk = f"SELECT dest_id, id, kmh, node_id AS pos, 0e0 AS road, 0e0 AS drive FROM start UNION ALL SELECT dest_id, id, kmh, parent_node, road + length_m, drive + length_m * 3.6e0 / ({_limited('kmh')}) FROM walk JOIN parent p ON p.node_id = walk.pos AND p.key = walk.dest_id"
    done = "SELECT walk.dest_id, walk.id, road, drive, g.goal_m FROM walk JOIN (SELECT s.key, s.node_id, min(goal_m) AS goal_m FROM seed s JOIN f ON f.key = s.key AND f.node_id = s.node_id AND f.t_ms = s.t_ms GROUP BY 1, 2) g ON g.key = walk.dest_id AND g.node_id = walk.pos"
    arrive = """SELECT *, travel_s <= least(1.728e5, CAST(arrive_by_unix - ts_unix AS DOUBLE)) + 1e-6 AS reachable, round(ts_unix + travel_s, 6) AS eta_unix FROM (SELECT s.dest_id, s.id, ts_unix, arrive_by_unix, round(road + off_m + goal_m, 3) AS distance_m,
        round(d + CASE WHEN vtype = 'truck' THEN floor(d / 1.44e4) * 1.8e3 ELSE 0e0 END, 6) AS travel_s FROM (SELECT start.*, road, goal_m, round(drive + (off_m + goal_m) * 3.6e0 / kmh, 6) AS d FROM start JOIN done USING (dest_id, id)) s)"""
    return _with_field(body, "net_edge", "fleet", "ping", arc=ARC, cell=CELL, snap=SNAP, prep=PREP, dest=DEST_SQL, gsnap=snap, seed=seed, w=w, entry=entry, after={"start": start, "parent": parent, "walk(dest_id, id, kmh, pos, road, drive)": walk, "done": done, "arrive": arrive})


def _arrivals(spark: SparkSession, sf_dir: str, with_nodes: bool = False) -> DataFrame:
    return arrivals.arrivals(_prepared(spark, sf_dir), destinations(spark), views.net_edge(spark, sf_dir), views.net_node(spark, sf_dir), with_nodes=with_nodes)


def _ranked(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    return arrivals.ranked(_arrivals(spark, sf_dir), by).select("dest_id", "id", "reachable", "travel_s", "distance_m", "rank")


_RANKED = "SELECT dest_id, id, reachable, travel_s, distance_m, CAST(row_number() OVER (PARTITION BY dest_id ORDER BY reachable DESC, {by}, id) AS INTEGER) AS rank FROM arrive"


@query(_arrive_sql(_RANKED.format(by="travel_s")))
def arrive_ranked_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "duration")


@query(_arrive_sql(_RANKED.format(by="eta_unix")))
def arrive_ranked_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "eta")


@query(_arrive_sql(_RANKED.format(by="distance_m")))
def arrive_ranked_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "distance")


@query(_arrive_sql("SELECT id FROM fleet WHERE vtype = 'truck' AND id NOT IN (SELECT id FROM arrive WHERE reachable AND dest_id = 'D2')"))
def anti_unreached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trucks that don't reach the second destination in time."""
    there = _arrivals(spark, sf_dir).filter("reachable and dest_id = 'D2'")
    return fleetops.unreached(views.fleet(spark, sf_dir).filter("vtype = 'truck'"), there).select("id")


_GEO = f"SELECT dest_id, id, vtype, ts_unix, arrive_by_unix, kmh, round(d * 1.25e0, 3) AS distance_m FROM (SELECT *, speed_kmh AS kmh, round({hav('lat', 'lon', 'dlat', 'dlon')}, 3) AS d FROM fleet JOIN dest ON dtype = vtype) WHERE d >= 5e3"


@query(with_views("SELECT dest_id, id, distance_m, travel_s FROM (SELECT *, round(distance_m / (kmh / 3.6e0) + CASE WHEN vtype = 'truck' THEN floor(distance_m / (kmh / 3.6e0) / 1.44e4) * 1.8e3 ELSE 0e0 END, 3) AS travel_s FROM far) WHERE arrive_by_unix - ts_unix >= 1 AND travel_s <= arrive_by_unix - ts_unix + 1e-6", "fleet", dest=DEST_SQL, far=_GEO))
def arrive_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.fleet(spark, sf_dir).withColumn("kmh", F.col("speed_kmh"))
    return arrivals.geodesic_arrivals(v, destinations(spark), 5_000.0).select("dest_id", "id", "distance_m", "travel_s")


@query(_arrive_sql("SELECT dest_id, count(*) AS n, CAST(sum(CASE WHEN reachable THEN 1 ELSE 0 END) AS BIGINT) AS n_reachable, min(id) AS first_id, TRUE AS has_route FROM arrive GROUP BY dest_id"))
def json_arrival_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals' JSON, read back."""
    rows = arrivals.with_polylines(arrivals.ranked(_arrivals(spark, sf_dir, with_nodes=True)), views.net_node(spark, sf_dir))
    j = export.arrival_json(rows, destinations(spark))
    v = F.from_json(F.get_json_object("json", "$.vehicles"), "array<struct<reachable:boolean,vehicleId:string,route:array<array<double>>>>")
    one = j.select("dest_id", F.explode(v).alias("v"))
    return one.groupBy("dest_id").agg(F.count("*").alias("n"), F.count_if("v.reachable").alias("n_reachable"), F.min("v.vehicleId").alias("first_id"), F.bool_and(F.size("v.route") >= 2).alias("has_route"))


@query(_route_sql(_LEAD, "SELECT best.a, best.b, best.t IS NOT NULL AS found, x.len AS self_m, y.len AS partner_m, x.len IS NOT NULL AS drawn FROM best LEFT JOIN way x ON x.a = best.a AND x.b = best.b AND x.side = 'self' LEFT JOIN way y ON y.a = best.a AND y.b = best.b AND y.side = 'partner'"))
def json_lead_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead's JSON, read back."""
    j = export.lead_json(meetings.ranked_for_lead(_routed(spark, sf_dir, _meetings(spark, sf_dir, _lead_pairs(spark, sf_dir)))))
    m = F.from_json(F.get_json_object("json", "$.meetings"), "array<struct<found:boolean,partner:string,routeDistanceSelfM:double,routeDistancePartnerM:double,routeSelf:array<array<double>>>>")
    rows = j.select("a", F.explode(m).alias("m"))
    return rows.select("a", F.col("m.partner").alias("b"), "m.found", F.col("m.routeDistanceSelfM").alias("self_m"), F.col("m.routeDistancePartnerM").alias("partner_m"), (F.coalesce(F.size("m.routeSelf"), F.lit(-1)) > 0).alias("drawn"))


@query(_route_sql(_FOCAL, "SELECT c.a, c.b AS partner, TRUE AS found, x.len AS self_m, y.len AS partner_m FROM soonest c LEFT JOIN way x ON x.a = c.a AND x.b = c.b AND x.side = 'self' LEFT JOIN way y ON y.a = c.a AND y.b = c.b AND y.side = 'partner'", "SELECT * FROM soonest").replace(", mspot AS (", f", soonest AS ({_SOONEST}), mspot AS (", 1))
def json_meeting_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focal vehicles' best meetings as JSON, read back."""
    j = export.meeting_json(_routed(spark, sf_dir, _soonest(spark, sf_dir)))
    get = lambda name, kind: F.get_json_object("json", f"$.{name}").cast(kind)
    return j.select(get("focal", "string").alias("a"), get("partner", "string").alias("partner"), get("found", "boolean").alias("found"), get("routeDistanceSelfM", "double").alias("self_m"), get("routeDistancePartnerM", "double").alias("partner_m"))


@query(with_views(f"SELECT id, round({hav('lat', 'lon', '2.22e1', '1.132e2')}, 3) AS dist_m, CAST(row_number() OVER (ORDER BY round({hav('lat', 'lon', '2.22e1', '1.132e2')}, 3), id) AS INTEGER) AS rank FROM fleet ORDER BY dist_m, id LIMIT 10", "fleet"))
def topk_nearest_to_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vehicles nearest to a point: a top report."""
    from pyspark.sql import Window

    rows = views.fleet(spark, sf_dir).select("id", F.round(haversine_m(F.col("lat"), F.col("lon"), 22.2, 113.2), 3).alias("dist_m")).orderBy("dist_m", "id").limit(10)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("dist_m", "id")))


@query(_with_field("SELECT id, min(t_ms + off) AS t_ms FROM f JOIN ends ON ends.node_id = f.node_id GROUP BY id", "net_edge", "fleet", arc=ARC, cell=CELL, snap=SNAP, w=_W60, seed=_SEED0, ends=f"SELECT id, node_id, CAST(0 AS BIGINT) AS off FROM snap WHERE edge_id = 0 UNION ALL SELECT id, node_from, {_ms('along_m', '6e1')} FROM snap WHERE edge_id <> 0 UNION ALL SELECT id, node_to, {_ms('greatest(length_m - along_m, 0e0)', '6e1')} FROM snap WHERE edge_id <> 0"))
def path_times_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field's time at every vehicle's place on its edge."""
    edges = views.net_edge(spark, sf_dir)
    places = spatial.nearest_edge(views.fleet(spark, sf_dir), edges).withColumn("kmh", F.lit(60.0))
    return paths.times_at(paths.time_fields(_source(spark), network.arcs(edges)), places).select("id", "t_ms")


@query(_with_field("SELECT key, node_id, t_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t_ms DESC, node_id) AS r FROM f) WHERE r = 1", "net_edge", "fleet", arc=ARC, cell=CELL, snap=SNAP, speeds=_SPEEDS, seed=_SEEDV, w=_WV))
def path_position_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each vehicle can be after ten minutes."""
    edges, fleet = views.net_edge(spark, sf_dir), views.fleet(spark, sf_dir)
    places = spatial.nearest_edge(fleet, edges).join(fleet.select("id", F.col("speed_kmh").alias("kmh"), motion.edge_type(F.col("vtype")).alias("etype")), "id")
    sources = paths.seeds(places).join(places.select("id", "kmh", "etype"), "id").select(F.col("id").alias("key"), "node_id", "t_ms", "kmh", "etype", F.lit(600_000).cast("bigint").alias("horizon_ms"))
    return paths.position_after(paths.time_fields(sources, network.arcs(edges)))
