"""Queries over fleets and telemetry: rankings, groups, regions, state, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetnet.functions import geo, motion
from fleetnet.functions.text import action_kind
from fleetnet.operators import fleetops, spatial
from fleetnet.plans import views
from fleetnet.plans.registry import query
from fleetnet.plans.scalars import DEADLINE, DEST_SQL, destinations
from fleetnet.plans.views import hav, with_views
from fleetnet.sources import requests
from fleetnet.streaming import state

_DIST = f"SELECT dest_id, id, round({hav('lat', 'lon', 'dlat', 'dlon')}, 3) AS dist_m FROM fleet JOIN dest ON dtype = vtype"


@query(with_views(f"SELECT a.id, b.id AS other_id, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS dist_m FROM fleet a JOIN fleet b ON a.id <> b.id AND a.vtype = b.vtype AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 6e3", "fleet"))
def join_fleet_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearby_vehicles(views.fleet(spark, sf_dir), 6_000.0).select("id", "other_id", "dist_m")


@query(with_views(f"SELECT id, other_id, rank FROM (SELECT id, other_id, CAST(row_number() OVER (PARTITION BY id ORDER BY d, other_id) AS INTEGER) AS rank FROM (SELECT a.id, b.id AS other_id, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS d FROM fleet a JOIN fleet b ON a.id <> b.id AND a.vtype = b.vtype AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 6e3)) WHERE rank <= 3", "fleet"))
def win_nearest_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearby_vehicles(views.fleet(spark, sf_dir), 6_000.0, most=3).select("id", "other_id", "rank")


_REGIONS = [("north", 10, 113.0, 22.12, 113.4, 24.0), ("south", 11, 113.0, 22.0, 113.4, 22.2), ("hk", 1, 113.1, 22.0, 113.25, 22.3), ("prd", 3, 112.0, 21.0, 116.0, 22.05), ("far", 12, 100.0, 10.0, 101.0, 11.0)]


def region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REGIONS, "suffix string, priority int, min_lon double, min_lat double, max_lon double, max_lat double")


REGION_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {p}, {a}e0, {b}e0, {c}e0, {d}e0)" for s, p, a, b, c, d in _REGIONS) + ") t(suffix, priority, min_lon, min_lat, max_lon, max_lat)"


def _region_of_sql(lat: str, lon: str) -> str:
    return f"(SELECT suffix FROM reg WHERE {lat} BETWEEN min_lat AND max_lat AND {lon} BETWEEN min_lon AND max_lon ORDER BY suffix IN ('hk', 'mo', 'prd'), priority LIMIT 1)"


@query(with_views(f"SELECT node_id, {_region_of_sql('lat', 'lon')} AS region FROM net_node", "net_node", reg=REGION_SQL))
def join_region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.region_of(views.net_node(spark, sf_dir), region_table(spark)).select("node_id", "region")


@query(with_views(f"SELECT region, count(*) AS n, round(avg(lat), 11) AS lat, round(avg(lon), 11) AS lon FROM (SELECT *, {_region_of_sql('lat', 'lon')} AS region FROM fleet) GROUP BY region", "fleet", reg=REGION_SQL))
def agg_home_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.region_of(views.fleet(spark, sf_dir), region_table(spark))
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 11).alias("lat"), F.round(F.avg("lon"), 11).alias("lon"))


_LINES = f"SELECT id AS line_id, i, {_region_of_sql('(lat + (2.23e1 - lat) * (i / 2.4e1))', '(lon + (1.1335e2 - lon) * (i / 2.4e1))')} AS region FROM fleet, (SELECT unnest(range(25)) AS i)"
_HOPS = "SELECT line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY i) AS INTEGER) AS hop, region FROM (SELECT *, lag(region) OVER (PARTITION BY line_id ORDER BY i) AS before FROM line WHERE region IS NOT NULL) WHERE before IS NULL OR before <> region"


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.fleet(spark, sf_dir).select(F.col("id").alias("line_id"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.lit(22.3).alias("lat1"), F.lit(113.35).alias("lon1"))
    return fleetops.regions_along(lines, region_table(spark), 24)


@query(with_views("SELECT line_id, hop, region FROM hops", "fleet", reg=REGION_SQL, line=_LINES, hops=_HOPS))
def win_regions_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir)


@query(with_views("""SELECT g, hop, region FROM (SELECT g, region, CAST(row_number() OVER (PARTITION BY g ORDER BY k) AS INTEGER) AS hop FROM (SELECT g, k, region, n FROM (SELECT node_id // 40 AS g, node_id % 40 + 1 AS k, concat('r', CAST(node_id % 40 AS VARCHAR)) AS region, count(*) OVER (PARTITION BY node_id // 40) AS n FROM net_node)
    WHERE n <= 5 OR k IN (1, 2 + (n - 2) // 4, 2 + (n - 2) * 2 // 4, 2 + (n - 2) * 3 // 4, n)))""", "net_node"))
def win_thin_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = views.net_node(spark, sf_dir).select(F.floor(F.col("node_id") / 40).cast("bigint").alias("line_id"), (F.col("node_id") % 40 + 1).cast("int").alias("hop"), F.concat(F.lit("r"), (F.col("node_id") % 40).cast("string")).alias("region"))
    return fleetops.thinned_hops(hops).withColumnRenamed("line_id", "g")


@query(with_views("SELECT vehicle, ping_id, ts, speed_kmh FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY ping_id DESC) AS r FROM ping) WHERE r = 1", "ping"))
def win_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleetops.latest_state(views.ping(spark, sf_dir)).select("vehicle", "ping_id", "ts", "speed_kmh")


@query(with_views("SELECT id, CAST(floor(lon / 2e-2) AS INTEGER) AS gx, CAST(floor(lat / 2e-2) AS INTEGER) AS gy, CAST((row_number() OVER (PARTITION BY floor(lon / 2e-2), floor(lat / 2e-2) ORDER BY id) - 1) // 2 AS INTEGER) AS cluster FROM fleet", "fleet"))
def win_grid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleetops.grid_clusters(views.fleet(spark, sf_dir), 0.02, 2)


@query(with_views("""SELECT dest_id, id, bearing, CAST((row_number() OVER (PARTITION BY dest_id ORDER BY bearing, id) - 1) // CAST(ceil(n / least(8, n)) AS BIGINT) AS INTEGER) AS bin FROM (SELECT dest_id, id, round(atan2(radians(lat - dlat), radians(lon - dlon) * cos(radians(dlat))), 6) AS bearing, CAST(count(*) OVER (PARTITION BY dest_id) AS DOUBLE) AS n FROM fleet JOIN dest ON dtype = vtype)""", "fleet", dest=DEST_SQL))
def win_bearing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = destinations(spark).select("dest_id", "vtype", F.col("lat").alias("dest_lat"), F.col("lon").alias("dest_lon"))
    return fleetops.bearing_bins(views.fleet(spark, sf_dir).join(F.broadcast(d), "vtype"), 8)  # three rows


#: The split of ``d`` (dest_id, id, dist_m): the upper median, far vehicles, and whether they are left out.
_SPLIT = """SELECT dest_id, id, dist_m, median, far AND NOT (CAST(sum(CASE WHEN far THEN 0 ELSE 1 END) OVER (PARTITION BY dest_id) AS BIGINT) < 8 AND median < 1.5e5) AS remote FROM (
    SELECT d.*, m.dist_m AS median, d.dist_m > 2.5e5 OR (d.dist_m > 2.5e0 * m.dist_m AND d.dist_m - m.dist_m > 1.2e5) AS far FROM d
    JOIN (SELECT dest_id, dist_m FROM (SELECT dest_id, dist_m, row_number() OVER (PARTITION BY dest_id ORDER BY dist_m) AS r, count(*) OVER (PARTITION BY dest_id) AS n FROM d) WHERE r = n // 2 + 1) m USING (dest_id))"""


@query(with_views(_SPLIT, "fleet", dest=DEST_SQL, d=_DIST))
def agg_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleetops.outlier_split(fleetops.distances(views.fleet(spark, sf_dir), destinations(spark))).select("dest_id", "id", "dist_m", "median", "remote")


@query(with_views(f"SELECT dest_id, id, dist_m, remote FROM ({_SPLIT})", "fleet", dest=DEST_SQL, dist=_DIST, d="SELECT dest_id, id, CASE WHEN id = 'V1' THEN dist_m * 1e2 ELSE dist_m END AS dist_m FROM dist"))
def flt_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fleetops.distances(views.fleet(spark, sf_dir), destinations(spark)).withColumn("dist_m", F.when(F.col("id") == "V1", F.col("dist_m") * 1e2).otherwise(F.col("dist_m")))
    return fleetops.outlier_split(d).select("dest_id", "id", "dist_m", "remote")


@query(with_views(f"SELECT CAST(floor(kmh / 10) AS INTEGER) AS bucket, count(*) AS n, min(kmh) AS min_kmh, max(horizon_s) AS max_horizon_s, max(dist_m) AS max_dist_m FROM (SELECT speed_kmh AS kmh, {DEADLINE} - ts_unix AS horizon_s, round({hav('lat', 'lon', '2.22e1', '1.132e2')}, 3) AS dist_m FROM fleet) GROUP BY 1", "fleet"))
def agg_speed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.fleet(spark, sf_dir).select(F.col("speed_kmh").alias("kmh"), (F.lit(DEADLINE) - F.col("ts_unix")).alias("horizon_s"), F.round(geo.haversine_m(F.col("lat"), F.col("lon"), 22.2, 113.2), 3).alias("dist_m"))
    return fleetops.speed_groups(rows, together=1_000_000)


@query(with_views("SELECT round(min(lon) - p, 9) AS min_lon, round(min(lat) - 5e3 / 1.11e5, 9) AS min_lat, round(max(lon) + p, 9) AS max_lon, round(max(lat) + 5e3 / 1.11e5, 9) AS max_lat FROM fleet, (SELECT 5e3 / (1.11e5 * greatest(2e-1, cos(radians((min(lat) + max(lat)) * 5e-1)))) AS p FROM fleet) GROUP BY p", "fleet"))
def agg_fleet_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fleetops.fleet_box(views.fleet(spark, sf_dir), 5_000.0)
    return b.select(*[F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query(with_views("SELECT vtype, count(*) AS n, min(ts_unix) AS first_ts, max(ts_unix) AS last_ts, round(avg(lat), 11) AS lat, round(avg(lon), 11) AS lon FROM fleet GROUP BY vtype", "fleet"))
def agg_fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleetops.fleet_summary(views.fleet(spark, sf_dir))


@query(with_views("SELECT vehicle, time_bucket(INTERVAL 10 MINUTES, ts) AS start, count(*) AS n, round(avg(speed_kmh), 11) AS mean_kmh FROM ping GROUP BY 1, 2", "ping"))
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.windowed_speeds(views.ping(spark, sf_dir))


@query(with_views("SELECT vehicle, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM (SELECT vehicle, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY ts, ping_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY vehicle ORDER BY ts, ping_id) AS before FROM ping)) GROUP BY vehicle, s", "ping"))
def stream_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.trips(views.ping(spark, sf_dir))


@query("SELECT id, seq, speed_kmh FROM (SELECT concat('V', CAST(user_id AS VARCHAR)) AS id, event_id AS seq, round(value / 5e0, 3) AS speed_kmh, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, event_id % 9 = 0 AS removed FROM events) WHERE r = 1 AND NOT removed")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state table after two batches: the last arrival of each vehicle, unless it took the vehicle out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    none = F.array().cast("array<double>")
    rows = e.select(F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("seq"), F.lit("truck").alias("vtype"), F.lit(22.0).alias("lat"), F.lit(113.0).alias("lon"), F.round(F.col("value") / 5e0, 3).alias("speed_kmh"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_unix"), none.alias("history"), (F.col("event_id") % 9 == 0).alias("removed"))
    first = state.merge_latest(rows.limit(0), rows.filter("seq % 2 = 0"))
    return state.present(state.merge_latest(first, rows.filter("seq % 2 = 1"))).select("id", "seq", "speed_kmh")


_JSON = "concat('{\"id\":\"', id, '\",\"type\":\"', vtype, '\",\"lat\":', CAST(lat AS VARCHAR(40)), ',\"lon\":', CAST(lon AS VARCHAR(40)), ',\"speed\":', CAST(speed_kmh AS VARCHAR(40)), ',\"time\":\"2024-01-01T00:0', CAST(s_suppkey % 10 AS VARCHAR(4)), ':00Z\",\"history\":[60.5,61.5]}')"


def _vehicle_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fleet(spark, sf_dir).select("s_suppkey", F.expr(_JSON.replace("VARCHAR(40)", "STRING").replace("VARCHAR(4)", "STRING")).alias("json"))


@query(with_views("SELECT id, vtype, round(lat, 9) AS lat, round(lon, 9) AS lon, speed_kmh, ts_unix, 6.1e1 AS history_kmh, TRUE AS valid FROM fleet", "fleet"))
def json_vehicle_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = requests.vehicles(_vehicle_json(spark, sf_dir))
    return v.select("id", "vtype", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "speed_kmh", "ts_unix", motion.history_mean(F.col("history")).alias("history_kmh"), "valid")


@query(with_views("SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY s_suppkey) - 1 AS INTEGER) AS ord, CASE WHEN s_suppkey % 11 = 3 THEN NULL ELSE id END AS id, NOT bool_or(s_suppkey % 11 = 3) OVER (PARTITION BY request_id) AS valid FROM (SELECT *, s_suppkey // 7 AS request_id FROM fleet)", "fleet"))
def json_fleet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vehicle_json(spark, sf_dir).withColumn("json", F.when(F.col("s_suppkey") % 11 == 3, F.lit('{"lat":1}')).otherwise(F.col("json")))
    lists = v.groupBy(F.floor(F.col("s_suppkey") / 7).cast("bigint").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "json"))).alias("v"))
    body = F.concat(F.lit('{"action":"meet_with_lead","vehicles":['), F.array_join(F.transform("v", lambda x: x["json"]), ","), F.lit("]}"))
    return requests.fleets(lists.select("request_id", body.alias("json"))).select("request_id", "ord", "id", "valid")


@query("SELECT p_partkey AS request_id, CASE p_size % 5 WHEN 0 THEN 'preload' WHEN 1 THEN 'destination' WHEN 2 THEN 'lead' WHEN 3 THEN 'destination' ELSE 'vehicle' END AS kind FROM part")
def json_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = ['{"action":"preload","bbox":"1,2,3,4"}', '{"action":"destination_arrival","lat":1}', '{"vehicles":[{"id":"A","lat":1}]}', '{"lat":1,"lon":2,"arriveBy":"2024-01-01T00:00:00Z","vehicles":[{"id":"A"}]}', '{"id":"A","lat":1,"lon":2,"speed":3}']
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("request_id"), action_kind(F.element_at(F.array(*map(F.lit, bodies)), (F.col("p_size") % 5 + 1).cast("int"))).alias("kind"))


@query("SELECT p_partkey AS request_id, 2.25e1 AS lat, 1.131e2 AS lon, CAST(1704067200 + p_size * 60 AS BIGINT) AS arrive_by_unix, CASE WHEN p_size % 2 = 0 THEN 'train' ELSE 'truck' END AS vtype, CASE WHEN p_size % 3 = 0 THEN 'eta' ELSE 'duration' END AS sort_by, TRUE AS valid FROM part")
def json_destination_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.concat(F.lit('{"vehicles":[{"id":"A","type":"boat","lat":9,"lon":9}],"lat":22.5,"lon":113.1,"arriveBy":"'), time, F.lit('","type":"'), F.when(k % 2 == 0, "train").otherwise("truck"), F.lit('","sortBy":"'), F.when(k % 3 == 0, "arrive").otherwise("x"), F.lit('"}'))
    return requests.destinations(p.select(F.col("p_partkey").alias("request_id"), body.alias("json")))


@query("SELECT p_partkey AS request_id, 1.1e1 AS min_lon, 2e0 AS min_lat, 1.3e1 AS max_lon, 4e0 AS max_lat FROM part")
def json_preload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    body = F.when(F.col("p_size") % 2 == 0, '{"action":"preload","bbox":"11, 2,13,4"}').otherwise('{"action":"preload","minLon":11,"minLat":2,"maxLon":13,"maxLat":4}')
    return requests.preloads(p.select(F.col("p_partkey").alias("request_id"), body.alias("json")))


@query(with_views("SELECT id, lat, lon, speed_kmh, ts_unix FROM fleet WHERE s_suppkey % 5 > 0", "fleet"))
def csv_vehicle_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.fleet(spark, sf_dir)
    line = F.concat_ws(",", "id", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("speed_kmh").cast("string"), F.when(F.col("s_suppkey") % 5 > 0, F.col("ts_unix").cast("string")).otherwise("soon"))
    return requests.command_line_vehicles(f.select(line.alias("line"))).select("id", "lat", "lon", "speed_kmh", "ts_unix")


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00001') OR contains('00001', lower(s_name)) ORDER BY length(s_name), s_name LIMIT 5")
def src_places_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_name").alias("name"))
    return requests.places_named(s, "00001", 5).withColumnRenamed("name", "s_name")


@query(with_views(f"SELECT vehicle, count(*) AS n, CAST(sum(CASE WHEN moved <= 1e3 AND (dt <= 0 OR moved <= dt * 75 + 500) THEN 1 ELSE 0 END) AS BIGINT) AS n_reused FROM (SELECT vehicle, speed_kmh * 2e1 AS moved, CAST(epoch(ts) - epoch(before) AS DOUBLE) AS dt FROM (SELECT *, lag(ts) OVER (PARTITION BY vehicle ORDER BY ping_id) AS before FROM ping)) WHERE dt IS NOT NULL GROUP BY vehicle", "ping"))
def flt_plausible_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("vehicle").orderBy("ping_id"))
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rows = views.ping(spark, sf_dir).withColumn("_b", before).filter("_b is not null").withColumn("dt", sec(F.col("ts")) - sec(F.col("_b")))
    ok = motion.plausible_move(F.col("speed_kmh") * 20.0, F.col("dt"))
    return rows.groupBy("vehicle").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_reused"))


@query(with_views("SELECT CAST(round(lat * 1000) AS BIGINT) AS lat_q, CAST(round(lon * 1000) AS BIGINT) AS lon_q, CAST(floor(speed_kmh * 2e2 / 1e3) AS INTEGER) AS width_q, CAST(floor(speed_kmh / 3.6e0 * 3.6e0 / 10) AS INTEGER) AS speed_q, count(*) AS n FROM fleet GROUP BY ALL", "fleet"))
def agg_request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = motion.request_key(F.col("lat"), F.col("lon"), F.col("speed_kmh") * 200.0, motion.ms(F.col("speed_kmh")))
    return views.fleet(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'china_map' WHEN 1 THEN 'kazakhstan' ELSE 'layer' END AS slug FROM part")
def fn_layer_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetnet.functions.text import layer_slug

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.element_at(F.array(*map(F.lit, ["/a/b/China map.mbtiles", "Kazakhstan.mbtiles", "/x/##.db"])), (F.col("p_size") % 3 + 1).cast("int"))
    return p.select("p_partkey", layer_slug(name).alias("slug"))
