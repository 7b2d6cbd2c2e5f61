"""Queries over the scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetnet.functions import geo, motion, routes, text
from fleetnet.operators import fleetops, network
from fleetnet.plans import views
from fleetnet.plans.registry import query
from fleetnet.plans.views import hav, with_views

DEST = (22.2, 113.2)
DEADLINE = 1704067200 + 7200
_R = "6.371e6"


@query(with_views(f"SELECT edge_id, round({hav('flat', 'flon', 'tlat', 'tlon')}, 3) AS dist_m FROM net_edge", "net_edge"))
def fn_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.net_edge(spark, sf_dir).select("edge_id", F.round(geo.haversine_m(F.col("flat"), F.col("flon"), F.col("tlat"), F.col("tlon")), 3).alias("dist_m"))


@query(with_views(f"""SELECT node_id, round(x, 3) AS x_m, round(y, 3) AS y_m, round(2.2e1 + degrees(y / {_R}), 9) AS lat, round(1.13e2 + degrees(x / ({_R} * cos(radians(2.2e1)))), 9) AS lon
    FROM (SELECT node_id, radians(lon - 1.13e2) * cos(radians(2.2e1)) * {_R} AS x, radians(lat - 2.2e1) * {_R} AS y FROM net_node)""", "net_node"))
def fn_local_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.to_local_m(F.col("lat"), F.col("lon"), 22.0, 113.0)
    n = views.net_node(spark, sf_dir).select("node_id", x.alias("x"), y.alias("y"))
    lat, lon = geo.from_local_m(F.col("x"), F.col("y"), 22.0, 113.0)
    return n.select("node_id", F.round("x", 3).alias("x_m"), F.round("y", 3).alias("y_m"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


def seg_sql(lat: str, lon: str, a: tuple[str, str], b: tuple[str, str]) -> dict[str, str]:
    """SQL of a point's distance to a segment and its share along it, in terms of the plane at the point."""
    x = lambda v: f"(radians({v} - ({lon})) * cos(radians({lat})) * {_R})"
    y = lambda v: f"(radians({v} - ({lat})) * {_R})"
    ax, ay, bx, by = x(a[1]), y(a[0]), x(b[1]), y(b[0])
    sq = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    t = f"(CASE WHEN {sq} > 1e-9 THEN greatest(0e0, least(1e0, ((0e0 - {ax}) * ({bx} - {ax}) + (0e0 - {ay}) * ({by} - {ay})) / {sq})) ELSE 0e0 END)"
    d = f"sqrt(pow(0e0 - ({ax} + {t} * ({bx} - {ax})), 2e0) + pow(0e0 - ({ay} + {t} * ({by} - {ay})), 2e0))"
    return {"t": t, "d": d}


_S = seg_sql("2.22e1", "1.132e2", ("flat", "flon"), ("tlat", "tlon"))


@query(with_views(f"SELECT edge_id, round({_S['d']}, 3) AS dist_m, round({_S['t']}, 6) AS share FROM net_edge", "net_edge"))
def fn_segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = geo.point_segment(*map(F.lit, DEST), F.col("flat"), F.col("flon"), F.col("tlat"), F.col("tlon"))
    return views.net_edge(spark, sf_dir).select("edge_id", F.round(d, 3).alias("dist_m"), F.round(t, 6).alias("share"))


def box_sql(alat: str, alon: str, blat: str, blon: str, m: str) -> dict[str, str]:
    pad = f"({m} / (1.11e5 * greatest(2e-1, cos(radians((({alat}) + ({blat})) * 5e-1)))))"
    return {"min_lon": f"(least({alon}, {blon}) - {pad})", "min_lat": f"(least({alat}, {blat}) - {m} / 1.11e5)", "max_lon": f"(greatest({alon}, {blon}) + {pad})", "max_lat": f"(greatest({alat}, {blat}) + {m} / 1.11e5)"}


_B = box_sql("flat", "flon", "tlat", "tlon", "5e3")


@query(with_views("SELECT edge_id, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in _B.items()) + " FROM net_edge", "net_edge"))
def fn_bbox_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.segment_box(F.col("flat"), F.col("flon"), F.col("tlat"), F.col("tlon"), 5000.0)
    return views.net_edge(spark, sf_dir).select("edge_id", b.alias("b")).select("edge_id", *[F.round(f"b.{k}", 9).alias(k) for k in _B])


@query(with_views("SELECT node_id, CAST(floor(lat / 2e-2) AS INTEGER) AS gx, CAST(floor(lon / 2e-2) AS INTEGER) AS gy, CAST(floor(lat / 2.5e-1) AS INTEGER) AS tx, CAST(floor(lon / 2.5e-1) AS INTEGER) AS ty FROM net_node", "net_node"))
def fn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, s: geo.cell(F.col(c), s)
    return views.net_node(spark, sf_dir).select("node_id", at("lat", geo.EDGE_CELL).alias("gx"), at("lon", geo.EDGE_CELL).alias("gy"), at("lat", geo.TILE_CELL).alias("tx"), at("lon", geo.TILE_CELL).alias("ty"))


@query(with_views("""SELECT id, round(greatest(CASE WHEN lim > 0e0 THEN least(k, lim) ELSE k END, 1e0), 9) AS kmh FROM (
    SELECT id, lim, CASE WHEN h > 0e0 AND g > 0e0 THEN 8.5e-1 * h + 1.5e-1 * g WHEN h > 0e0 THEN h WHEN g > 0e0 THEN g ELSE 8e-1 * CASE WHEN lim > 0e0 THEN lim WHEN vtype = 'train' THEN 8e1 ELSE 6e1 END END AS k
    FROM (SELECT id, vtype, CASE WHEN s_suppkey % 3 = 0 THEN 0e0 ELSE speed_kmh END AS g, CASE WHEN s_suppkey % 2 = 0 THEN 0e0 ELSE round(m, 11) END AS h, CASE s_suppkey % 4 WHEN 0 THEN 0e0 ELSE 2e1 * (s_suppkey % 4) END AS lim
          FROM fleet LEFT JOIN (SELECT vehicle, avg(speed_kmh) AS m FROM ping GROUP BY vehicle) p ON p.vehicle = s_suppkey))""", "fleet", "ping"))
def fn_speed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = views.ping(spark, sf_dir).groupBy("vehicle").agg(F.round(F.avg("speed_kmh"), 11).alias("m"))
    rows = views.fleet(spark, sf_dir).join(means, F.col("vehicle") == F.col("s_suppkey"), "left")
    k = F.col("s_suppkey")
    gps, history = F.when(k % 3 == 0, 0.0).otherwise(F.col("speed_kmh")), F.when(k % 2 == 0, 0.0).otherwise(F.col("m"))
    return rows.select("id", F.round(motion.fused_kmh(gps, history, (k % 4 * 20).cast("double"), F.col("vtype")), 9).alias("kmh"))


@query(with_views("SELECT edge_id, round(d / v + CASE WHEN etype = 0 THEN floor(d / v / 1.44e4) * 1.8e3 ELSE 0e0 END, 3) AS travel_s FROM (SELECT edge_id, etype, length_m * (edge_id % 700) AS d, 6e1 / 3.6e0 AS v FROM net_edge)", "net_edge"))
def fn_travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    vtype = F.when(F.col("etype") == 0, "truck").otherwise("train")
    return views.net_edge(spark, sf_dir).select("edge_id", F.round(motion.travel_s(F.col("length_m") * (F.col("edge_id") % 700), motion.ms(60.0), vtype), 3).alias("travel_s"))


@query(with_views("SELECT edge_id, round(CASE WHEN speed_kmh > 0e0 THEN least(5.5e1 / 3.6e0, speed_kmh / 3.6e0) ELSE 5.5e1 / 3.6e0 END, 6) AS speed_ms, round(length_m / CASE WHEN speed_kmh > 0e0 THEN least(8e1 / 3.6e0, speed_kmh / 3.6e0) ELSE 8e1 / 3.6e0 END, 6) AS profile_s FROM net_edge", "net_edge"))
def fn_edge_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.net_edge(spark, sf_dir).select("edge_id", F.round(motion.edge_ms(motion.ms(55.0), F.col("speed_kmh")), 6).alias("speed_ms"), F.round(motion.profile_s(F.col("length_m"), F.col("speed_kmh")), 6).alias("profile_s"))


_TAG = "CASE p_size % 7 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN '80 km/h' WHEN 3 THEN '60kmh' WHEN 4 THEN ' 25MPH ' WHEN 5 THEN 'none' ELSE NULL END"


@query(f"SELECT p_partkey, round(CASE p_size % 7 WHEN 0 THEN 5e1 WHEN 1 THEN 3e1 * 1.60934e0 WHEN 2 THEN 8e1 WHEN 3 THEN 6e1 WHEN 4 THEN 2.5e1 * 1.60934e0 ELSE 0e0 END, 6) AS kmh FROM part WHERE coalesce({_TAG}, '') IS NOT NULL")
def fn_parse_maxspeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_TAG).alias("tag"))
    return tags.select("p_partkey", F.round(text.maxspeed_kmh(F.col("tag")), 6).alias("kmh"))


@query(with_views("SELECT edge_id, flon AS min_lon, flat AS min_lat, tlon AS max_lon, tlat AS max_lat FROM net_edge WHERE edge_id % 3 > 0 UNION ALL SELECT edge_id, NULL, NULL, NULL, NULL FROM net_edge WHERE edge_id % 3 = 0", "net_edge"))
def fn_parse_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.net_edge(spark, sf_dir)
    said = F.when(F.col("edge_id") % 3 > 0, F.concat_ws(", ", *[F.col(c).cast("string") for c in ("flon", "flat", "tlon", "tlat")])).otherwise(F.concat_ws(",", F.col("flon").cast("string"), F.lit("x")))
    rows = e.select("edge_id", text.box_numbers(said).alias("b"))
    return rows.select("edge_id", *[F.get("b", i).alias(c) for i, c in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))])


@query("SELECT event_id, CAST(epoch(CASE WHEN event_id % 4 = 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END) AS BIGINT) AS unix_s, strftime(CASE WHEN event_id % 4 = 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def fn_iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    said = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("z ")))
    rows = e.select("event_id", text.utc_seconds(said).alias("unix_s"))
    return rows.select("event_id", "unix_s", text.utc_text(F.col("unix_s")).alias("iso"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'eta' WHEN p_size % 4 = 1 THEN 'distance' ELSE 'duration' END AS sort_key,
    CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE concat('edge:', CAST((p_partkey + 1) * 10 AS VARCHAR)) END AS location_id,
    CASE WHEN p_size % 2 = 0 THEN '/data/cn_gd.net.bin' ELSE 'cn_gd' END AS path FROM part""")
def fn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    word = F.element_at(F.array(*map(F.lit, ["arrival", "routeDistance", "", "fastest"])), (k % 4 + 1).cast("int"))
    edge = F.when(k % 2 == 0, F.lit(0)).otherwise((F.col("p_partkey") + 1) * 10)
    path = F.when(k % 2 == 0, "/data/cn.net.bin").otherwise("cn")
    return p.select("p_partkey", text.sort_key(word).alias("sort_key"), text.location_id(F.col("p_partkey"), edge).alias("location_id"), text.regional_path(path, F.lit("gd")).alias("path"))


@query(with_views("""SELECT node_id, round(least(1.5e5, CASE WHEN d < 1.5e4 THEN greatest(5e3, d * 5e-1 + 4e3) WHEN d < 5e4 THEN greatest(7e3, d * 1.8e-1 + 5e3) WHEN d < 1e5 THEN greatest(9e3, d * 1.2e-1 + 6e3) WHEN d > 4e5 THEN 2.2e4 ELSE d * 2e-1 + 8e3 END), 3) AS destination_m,
    round(least(1.5e5, d * 3.5e-1 + 1.2e4), 3) AS pair_m, ceil(least(1.5e5, greatest(8e4, d + 2.5e4)) / 1e4) * 1e4 AS metro_m FROM (SELECT node_id, CAST(node_id AS DOUBLE) * 2.5e2 AS d FROM net_node)""", "net_node"))
def fn_corridor_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("node_id").cast("double") * 250.0
    return views.net_node(spark, sf_dir).select("node_id", F.round(geo.destination_corridor_m(d, 150_000), 3).alias("destination_m"), F.round(geo.pair_corridor_m(d, 150_000), 3).alias("pair_m"), geo.metro_radius_m(d).alias("metro_m"))


_PAIR = f"SELECT a.id AS a, b.id AS b, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS d, a.speed_kmh / 3.6e0 AS va, b.speed_kmh / 3.6e0 AS vb, a.vtype AS ta, b.vtype AS tb FROM fleet a JOIN fleet b ON b.s_suppkey = a.s_suppkey + 1"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.fleet(spark, sf_dir)
    b = f.select(F.col("id").alias("b"), (F.col("s_suppkey") - 1).alias("_k"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), motion.ms(F.col("speed_kmh")).alias("vb"), F.col("vtype").alias("tb"))
    return f.join(b, F.col("s_suppkey") == F.col("_k")).select(F.col("id").alias("a"), "b", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), 3).alias("d"), motion.ms(F.col("speed_kmh")).alias("va"), "vb", F.col("vtype").alias("ta"), "tb")


@query(with_views("SELECT a, b, round(least(1.728e5, greatest(4.8e2, d / greatest(5e0, least(va, vb)) * 1.35e0 + 2.4e2)), 3) AS horizon_s FROM pair", "fleet", pair=_PAIR))
def fn_pair_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(motion.pair_horizon_s(F.col("d"), F.col("va"), F.col("vb")), 3).alias("horizon_s"))


@query(with_views("SELECT a, b, d FROM pair WHERE ta = tb AND d <= (va + vb) * 6e2 * 5.5e-1 + 5e3", "fleet", pair=_PAIR))
def flt_pair_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = motion.Params(max_time=600.0)
    return _pairs(spark, sf_dir).filter("ta = tb").filter(motion.within_pair_reach(F.col("d"), F.col("va"), F.col("vb"), p)).select("a", "b", "d")


@query(with_views(f"SELECT id FROM (SELECT id, round({hav('lat', 'lon', '2.22e1', '1.132e2')}, 3) AS d, greatest(speed_kmh / 3.6e0, 5e0) * 6.5e-1 AS v, {1704067200 + 900} - ts_unix AS h FROM fleet WHERE vtype = 'truck') WHERE h >= 1 AND d / v <= h + 120", "fleet"))
def flt_deadline_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.round(geo.haversine_m(F.col("lat"), F.col("lon"), *DEST), 3)
    return views.fleet(spark, sf_dir).filter("vtype = 'truck'").filter(motion.may_arrive(d, motion.ms(F.col("speed_kmh")), F.lit(1704067200 + 900) - F.col("ts_unix"))).select("id")


@query(with_views("SELECT edge_id FROM net_edge WHERE etype = 1", "net_edge"))
def flt_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.net_edge(spark, sf_dir).filter(F.col("etype") == motion.edge_type(F.lit("train"))).select("edge_id")


@query(with_views("SELECT edge_id FROM net_edge WHERE etype = 0 AND (speed_kmh >= 6e1 OR (speed_kmh >= 4.5e1 AND length_m >= 4e2))", "net_edge"))
def flt_primary_highway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.net_edge(spark, sf_dir).filter(motion.primary_highway(F.col("etype"), F.col("speed_kmh"), F.col("length_m"))).select("edge_id")


def destinations(spark: SparkSession) -> DataFrame:
    """Two destinations for trucks and one for trains; the third's deadline has passed for some vehicles."""
    rows = [("D1", 22.2, 113.2, "truck", DEADLINE), ("D2", 22.05, 113.1, "truck", 1704067200 + 1800), ("D3", 22.1, 113.15, "train", 1704067200 + 300)]
    return spark.createDataFrame(rows, "dest_id string, lat double, lon double, vtype string, arrive_by_unix bigint")


DEST_SQL = f"SELECT * FROM (VALUES ('D1', 2.22e1, 1.132e2, 'truck', CAST({DEADLINE} AS BIGINT)), ('D2', 2.205e1, 1.131e2, 'truck', CAST({1704067200 + 1800} AS BIGINT)), ('D3', 2.21e1, 1.1315e2, 'train', CAST({1704067200 + 300} AS BIGINT))) t(dest_id, dlat, dlon, dtype, arrive_by_unix)"


@query(with_views("SELECT dest_id, n_vehicles, latest, n_vehicles > 0 AND arrive_by_unix > latest AS valid FROM dest CROSS JOIN (SELECT count(*) AS n_vehicles, max(ts_unix) AS latest FROM fleet)", "fleet", dest=DEST_SQL))
def flt_request_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleetops.late_requests(destinations(spark), views.fleet(spark, sf_dir)).select("dest_id", "n_vehicles", "latest", "valid")


@query(with_views("SELECT id, round(atan2(radians(lat - 2.22e1), radians(lon - 1.132e2) * cos(radians(2.22e1))), 6) AS bearing FROM fleet", "fleet"))
def fn_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fleet(spark, sf_dir).select("id", F.round(geo.bearing_rad(F.col("lat"), F.col("lon"), *DEST), 6).alias("bearing"))


_BOX = {"min_lon": "1.1305e2", "min_lat": "2.203e1", "max_lon": "1.1315e2", "max_lat": "2.209e1"}
_T = "CASE WHEN {t} > 1e-9 AND {x} BETWEEN {min_lon} - 1e-6 AND {max_lon} + 1e-6 AND {y} BETWEEN {min_lat} - 1e-6 AND {max_lat} + 1e-6 THEN {t} END"


def _crossing(t: str) -> str:
    return _T.format(t=t, x=f"(1.131e2 + dx * ({t}))", y=f"(2.206e1 + dy * ({t}))", **_BOX)


_TS = [_crossing(f"((({v}) - 1.131e2) / nullif(dx, 0e0))") for v in (_BOX["min_lon"], _BOX["max_lon"])] + [_crossing(f"((({v}) - 2.206e1) / nullif(dy, 0e0))") for v in (_BOX["min_lat"], _BOX["max_lat"])]


@query(with_views(f"""SELECT node_id, round(CASE WHEN inb THEN lat WHEN t IS NOT NULL THEN greatest({_BOX['min_lat']}, least({_BOX['max_lat']}, 2.206e1 + dy * t)) ELSE greatest({_BOX['min_lat']}, least({_BOX['max_lat']}, lat)) END, 10) AS lat,
    round(CASE WHEN inb THEN lon WHEN t IS NOT NULL THEN greatest({_BOX['min_lon']}, least({_BOX['max_lon']}, 1.131e2 + dx * t)) ELSE greatest({_BOX['min_lon']}, least({_BOX['max_lon']}, lon)) END, 10) AS lon,
    round(least({_BOX['max_lat']} - 2e-2, greatest({_BOX['min_lat']} + 2e-2, lat)), 10) AS in_lat, round(least({_BOX['max_lon']} - 2e-2, greatest({_BOX['min_lon']} + 2e-2, lon)), 10) AS in_lon
    FROM (SELECT *, least({", ".join(_TS)}) AS t FROM (SELECT node_id, lat, lon, lon - 1.131e2 AS dx, lat - 2.206e1 AS dy, lat BETWEEN {_BOX['min_lat']} AND {_BOX['max_lat']} AND lon BETWEEN {_BOX['min_lon']} AND {_BOX['max_lon']} AS inb FROM net_node))""", "net_node"))
def fn_border_toward(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.box(*[float(_BOX[k]) for k in ("min_lon", "min_lat", "max_lon", "max_lat")])
    rows = views.net_node(spark, sf_dir).select("node_id", geo.border_toward(F.col("lat"), F.col("lon"), b).alias("o"), geo.clamp_into(F.col("lat"), F.col("lon"), b, 0.02).alias("i"))
    return rows.select("node_id", F.round("o.lat", 10).alias("lat"), F.round("o.lon", 10).alias("lon"), F.round("i.lat", 10).alias("in_lat"), F.round("i.lon", 10).alias("in_lon"))


@query("""SELECT p_partkey, round(x / n * 3.6e2 - 1.8e2, 8) AS min_lon, round(degrees(atan(sinh(3.141592653589793e0 * (1e0 - 2e0 * (y + 1e0) / n)))), 8) AS min_lat, round((x + 1e0) / n * 3.6e2 - 1.8e2, 8) AS max_lon, round(degrees(atan(sinh(3.141592653589793e0 * (1e0 - 2e0 * y / n)))), 8) AS max_lat, CAST(n - 1 - y AS BIGINT) AS tms_y
    FROM (SELECT p_partkey, CAST(p_partkey % 1024 AS DOUBLE) AS x, CAST(p_partkey * 7 % 1024 AS DOUBLE) AS y, 1.024e3 AS n FROM part)""")
def fn_tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit(10).alias("z"), (F.col("p_partkey") % 1024).alias("x"), (F.col("p_partkey") * 7 % 1024).alias("y"))
    rows = rows.withColumn("b", geo.tile_box(F.col("z"), F.col("x"), F.col("y")))
    return rows.select("p_partkey", *[F.round(f"b.{k}", 8).alias(k) for k in _BOX], geo.flipped_row(F.col("z"), F.col("y")).alias("tms_y"))


@query(with_views("""SELECT vtype, round(a - greatest(6e-2, greatest(c - a, 1.2e-2) * 3.5e-1), 7) AS min_lon, round(b - greatest(6e-2, greatest(d - b, 1.2e-2) * 3.5e-1), 7) AS min_lat, round(c + greatest(6e-2, greatest(c - a, 1.2e-2) * 3.5e-1), 7) AS max_lon, round(d + greatest(6e-2, greatest(d - b, 1.2e-2) * 3.5e-1), 7) AS max_lat
    FROM (SELECT vtype, min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS d FROM fleet GROUP BY vtype)""", "fleet"))
def fn_view_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = views.fleet(spark, sf_dir).groupBy("vtype").agg(F.min("lat").alias("a"), F.min("lon").alias("b"), F.max("lat").alias("c"), F.max("lon").alias("d"))
    return ends.select("vtype", geo.view_box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("v")).select("vtype", *[F.round(f"v.{k}", 7).alias(k) for k in _BOX])


@query(with_views("SELECT edge_id, round(flat + (tlat - flat) * 2.5e-1, 9) AS lat, round(flon + (tlon - flon) * 2.5e-1, 9) AS lon FROM net_edge", "net_edge"))
def fn_along_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.net_edge(spark, sf_dir).select("edge_id", F.round(geo.interpolate(F.col("flat"), F.col("tlat"), 0.25), 9).alias("lat"), F.round(geo.interpolate(F.col("flon"), F.col("tlon"), 0.25), 9).alias("lon"))


_ROUTE = f"SELECT node_id, g, k, lat, lon, CASE WHEN lag(lat) OVER w IS NOT NULL THEN {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} END AS d, count(*) OVER (PARTITION BY g) AS n FROM (SELECT node_id, lat, lon, node_id // 40 AS g, node_id % 40 AS k FROM net_node) WINDOW w AS (PARTITION BY g ORDER BY k)"


def grid_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route along each row of the grid."""
    n = views.net_node(spark, sf_dir)
    lists = n.groupBy(F.floor(F.col("node_id") / 40).cast("bigint").alias("g")).agg(F.array_sort(F.collect_list(F.struct("node_id", "lat", "lon"))).alias("_p"))
    return lists.select("g", F.transform("_p", lambda x: routes.point(x["lat"], x["lon"])).alias("route"))


@query(with_views("""SELECT g, round(coalesce(sum(d), 0e0), 3) AS length_m, round(coalesce(max(d), 0e0), 3) AS longest_m, count(*) >= 2 AND (coalesce(max(d), 0e0) <= 1.5e3 OR (max(d) <= 5e4 AND count(*) >= 4)) AS sound FROM route GROUP BY g""", "net_node", route=_ROUTE))
def fn_route_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("route")
    return grid_routes(spark, sf_dir).select("g", F.round(routes.length_m(r), 3).alias("length_m"), F.round(routes.longest_step_m(r), 3).alias("longest_m"), routes.sound(r, 1_500.0).alias("sound"))


@query(with_views("""SELECT g, i, lat, lon FROM (SELECT g, n, i, CASE WHEN n > 7 THEN i * (n - 1) // 6 ELSE i END AS pos FROM (SELECT DISTINCT g, n FROM route), (SELECT unnest(range(40)) AS i) WHERE i < least(n, 7)) JOIN (SELECT g, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS pos, lat, lon FROM route) USING (g, pos)""", "net_node", route=_ROUTE))
def fn_route_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid_routes(spark, sf_dir).select("g", F.posexplode(routes.thinned(F.col("route"), 7)).alias("i", "p"))
    return rows.select("g", F.col("i").cast("bigint").alias("i"), "p.lat", "p.lon")


@query()
def fn_route_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent folds; tests hold them against plain loops."""
    r = F.col("route")
    start = routes.point(F.get(r, 0)["lat"] + 0.001, F.get(r, 0)["lon"])
    return grid_routes(spark, sf_dir).select(
        "g", F.size(routes.without_repeats(r, 1_000.0)).alias("n_kept"), F.size(routes.with_start(r, start)).alias("n_started"), F.size(routes.sampled(r, routes.steps_m(r), F.lit(2_500.0))).alias("n_sampled"),
        F.size(routes.spread_out(r)).alias("n_spread"), routes.presentable(r, F.lit(200_000.0)).alias("presentable"), routes.follows_roads(r).alias("follows_roads"),
    )


@query(with_views("SELECT vehicle, round(avg(speed_kmh), 11) AS mean_kmh FROM ping GROUP BY vehicle", "ping"))
def agg_history_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.ping(spark, sf_dir).groupBy("vehicle").agg(F.collect_list("speed_kmh").alias("h"))  # a history is kept short by its source
    return lists.select("vehicle", F.round(motion.history_mean(F.col("h")), 11).alias("mean_kmh"))


@query(with_views("SELECT (SELECT count(*) FROM net_node) AS n_nodes, (SELECT count(*) FROM net_node WHERE kind = 0) AS n_kind0, (SELECT count(*) FROM net_node WHERE kind = 1) AS n_kind1, CAST(0 AS BIGINT) AS n_kind2, CAST(0 AS BIGINT) AS n_bad_coords, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, (SELECT count(*) FROM net_edge) AS n_edges, (SELECT count(*) FROM net_edge WHERE etype = 0) AS n_road, (SELECT count(*) FROM net_edge WHERE etype = 1) AS n_rail, CAST(0 AS BIGINT) AS n_bad_length FROM net_node", "net_edge"))
def agg_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.profile(views.net_node(spark, sf_dir), views.net_edge(spark, sf_dir))
