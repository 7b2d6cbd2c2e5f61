"""The network, fleet and telemetry that the registered queries run on, derived from the test tables.

Each view exists twice: as DataFrames here, and as SQL for the oracle (``SQL``); both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetnet.functions.geo import haversine_m
from fleetnet.storage import measured_broadcasts

COLUMNS = 40
SPACING = 9e-3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_broadcasts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def net_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, lat, lon, kind, p_size): a grid of 40 columns, about a kilometre apart."""
    row = F.floor(F.col("p_partkey").cast("double") / 4e1).cast("double")
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("node_id"), (F.lit(2.2e1) + row * SPACING).alias("lat"),
        (F.lit(1.13e2) + (F.col("p_partkey") % COLUMNS).cast("double") * SPACING).alias("lon"),
        F.when(F.col("p_size") % 10 == 0, 1).otherwise(0).alias("kind"), "p_size",
    )


def net_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, node_from, node_to, etype, length_m, speed_kmh, flat, flon, tlat, tlon): edges east and north."""
    a = net_node(spark, sf_dir)
    b = a.select(F.col("node_id").alias("_to"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    rail = F.floor(F.col("node_id").cast("double") / 4e1).cast("bigint") % 10 == 0
    ends = F.array(
        F.when(F.col("node_id") % COLUMNS < COLUMNS - 1, F.struct(F.lit(0).alias("k"), (F.col("node_id") + 1).alias("to"), F.when(rail, 1).otherwise(0).alias("etype"))),
        F.struct(F.lit(1).alias("k"), (F.col("node_id") + COLUMNS).alias("to"), F.lit(0).alias("etype")),
    )
    e = a.select("node_id", "lat", "lon", "p_size", F.explode(ends).alias("_e")).filter("_e is not null").join(b, F.col("_e.to") == F.col("_to"))
    limit = F.element_at(F.array(*map(F.lit, [0e0, 3e1, 5e1, 6e1, 8e1])), (F.col("p_size") % 5 + 1).cast("int"))
    return e.select(
        (F.col("node_id") * 10 + F.col("_e.k")).alias("edge_id"), F.col("node_id").alias("node_from"), F.col("_to").alias("node_to"), F.col("_e.etype").alias("etype"),
        F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")), 3).alias("length_m"), limit.alias("speed_kmh"),
        F.col("lat").alias("flat"), F.col("lon").alias("flon"), "tlat", "tlon",
    )


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vtype, lat, lon, speed_kmh, ts_unix, s_suppkey): a vehicle for each supplier."""
    n = net_node(spark, sf_dir)
    size = n.agg(F.count("*").alias("_n"))
    s = _table(spark, sf_dir, "supplier").crossJoin(F.broadcast(size))  # one row
    at = n.select("node_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return s.join(at, (F.col("s_suppkey") * 37) % F.col("_n") == F.col("node_id")).select(
        F.concat(F.lit("V"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_nationkey") % 8 == 0, "train").otherwise("truck").alias("vtype"),
        (F.col("_lat") + 1e-3).alias("lat"), (F.col("_lon") + ((F.col("s_suppkey") % 7).cast("double") - 3e0) * 5e-4).alias("lon"),
        (F.lit(3e1) + F.col("s_nationkey").cast("double") * 2e0).alias("speed_kmh"), (F.lit(1704067200) + (F.col("s_suppkey") % 10) * 60).cast("bigint").alias("ts_unix"), "s_suppkey",
    )


def ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ping_id, vehicle, ts, speed_kmh): telemetry in order of arrival."""
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("ping_id"), F.col("user_id").alias("vehicle"), "ts", F.round(F.col("value") / 5e0, 3).alias("speed_kmh"))


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The great-circle distance in SQL."""
    return f"(2e0 * 6.371e6 * asin(least(1e0, sqrt(pow(sin(radians({lat2} - ({lat1})) / 2e0), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2e0), 2e0)))))"


SQL = {
    "net_node": "SELECT p_partkey AS node_id, 2.2e1 + floor(CAST(p_partkey AS DOUBLE) / 4e1) * 9e-3 AS lat, 1.13e2 + CAST(p_partkey % 40 AS DOUBLE) * 9e-3 AS lon, CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END AS kind, p_size FROM part",
    "net_pair": """SELECT a.node_id * 10 + 0 AS edge_id, a.node_id AS node_from, b.node_id AS node_to, CASE WHEN floor(CAST(a.node_id AS DOUBLE) / 4e1) % 10 = 0 THEN 1 ELSE 0 END AS etype, a.lat AS flat, a.lon AS flon, b.lat AS tlat, b.lon AS tlon, a.p_size AS sz FROM net_node a JOIN net_node b ON b.node_id = a.node_id + 1 WHERE a.node_id % 40 < 39
        UNION ALL SELECT a.node_id * 10 + 1, a.node_id, b.node_id, 0, a.lat, a.lon, b.lat, b.lon, a.p_size FROM net_node a JOIN net_node b ON b.node_id = a.node_id + 40""",
    "net_edge": f"SELECT edge_id, node_from, node_to, etype, round({hav('flat', 'flon', 'tlat', 'tlon')}, 3) AS length_m, CASE sz % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 3e1 WHEN 2 THEN 5e1 WHEN 3 THEN 6e1 ELSE 8e1 END AS speed_kmh, flat, flon, tlat, tlon FROM net_pair",
    "fleet": "SELECT concat('V', CAST(s_suppkey AS VARCHAR(20))) AS id, CASE WHEN s_nationkey % 8 = 0 THEN 'train' ELSE 'truck' END AS vtype, n.lat + 1e-3 AS lat, n.lon + (CAST(s_suppkey % 7 AS DOUBLE) - 3e0) * 5e-4 AS lon, 3e1 + CAST(s_nationkey AS DOUBLE) * 2e0 AS speed_kmh, CAST(1704067200 + (s_suppkey % 10) * 60 AS BIGINT) AS ts_unix, s_suppkey FROM supplier CROSS JOIN (SELECT count(*) AS n_nodes FROM part) c JOIN net_node n ON n.node_id = (s_suppkey * 37) % c.n_nodes",
    "ping": "SELECT event_id AS ping_id, user_id AS vehicle, ts, round(value / 5e0, 3) AS speed_kmh FROM events",
}
_NEEDS = {"net_pair": ["net_node"], "net_edge": ["net_pair"], "fleet": ["net_node"]}


def with_views(body: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """``body`` after a WITH clause of the named views, what they need, and ``extra`` ones."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
