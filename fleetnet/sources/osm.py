"""OpenStreetMap XML as a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetnet.functions.geo import haversine_m
from fleetnet.functions.text import maxspeed_kmh

# The highway classes that are roads.
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "motorway_link", "trunk_link", "primary_link", "secondary_link")
STATIONS = ("station", "halt")

_NODE = "_id BIGINT, _lat DOUBLE, _lon DOUBLE, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
_WAY = "_id BIGINT, nd ARRAY<STRUCT<_ref: BIGINT>>, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"


def _tag(key: str) -> Column:
    """The value of an element's tag; of a key that it has twice, the last."""
    own = F.filter("tag", lambda t: t["_k"] == key)
    return F.element_at(F.when(F.size(own) > 0, own), -1)["_v"]


def read_ways(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(way_id, etype, speed_kmh, refs) of roads and rails with two nodes or more; of several inputs the last one's wins."""
    parts = [spark.read.format("xml").option("rowTag", "way").schema(_WAY).load(p).withColumn("_input", F.lit(i)) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy("_id").agg(F.max_by(F.struct("nd", "tag"), "_input").alias("_w")).select("_id", "_w.nd", "_w.tag")
    road = _tag("highway").isin(*ROADS) & ~F.coalesce(_tag("area") == "yes", F.lit(False))
    rail = _tag("railway") == "rail"
    etype = F.when(road, 0).when(rail, 1)
    return rows.select(F.col("_id").alias("way_id"), etype.alias("etype"), maxspeed_kmh(_tag("maxspeed")).alias("speed_kmh"), F.transform("nd", lambda n: n["_ref"]).alias("refs")).filter("etype is not null and size(refs) >= 2")


def read_nodes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(node_id, lat, lon, kind): kind 1 for railway stations; of several inputs the last one's wins."""
    parts = [spark.read.format("xml").option("rowTag", "node").schema(_NODE).load(p).withColumn("_input", F.lit(i)) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy("_id").agg(F.max_by(F.struct("_lat", "_lon", "tag"), "_input").alias("_n")).select("_id", "_n._lat", "_n._lon", "_n.tag")
    return rows.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.when(_tag("railway").isin(*STATIONS), 1).otherwise(0).alias("kind"))


def segments(ways: DataFrame, nodes: DataFrame, least_m: float = 1.0) -> DataFrame:
    """Edges of ways: one for each two consecutive nodes, numbered way * 10000 + place.

    Ways that lack a node are dropped, and segments under ``least_m``.
    """
    points = ways.select("way_id", "etype", "speed_kmh", F.size("refs").alias("_n"), F.posexplode("refs").alias("_k", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    order, whole = Window.partitionBy("way_id").orderBy("_k"), Window.partitionBy("way_id")
    rows = points.withColumn("_have", F.count("*").over(whole)).filter("_have = _n")
    nxt = lambda c, name: F.lead(c).over(order).alias(name)
    rows = rows.select("way_id", "etype", "speed_kmh", "_k", F.col("node_id").alias("node_from"), F.col("lat").alias("flat"), F.col("lon").alias("flon"), nxt("node_id", "node_to"), nxt("lat", "tlat"), nxt("lon", "tlon")).filter("node_to is not null")
    length = haversine_m(F.col("flat"), F.col("flon"), F.col("tlat"), F.col("tlon"))
    return rows.withColumn("length_m", length).filter(F.col("length_m") >= least_m).select((F.col("way_id") * 10_000 + F.col("_k")).alias("edge_id"), "node_from", "node_to", "etype", "length_m", "speed_kmh", "flat", "flon", "tlat", "tlon")


def network(spark: SparkSession, paths: list[str], bbox: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of OSM files: only nodes that ways refer to, inside the box if there is one; hubs are marked."""
    from fleetnet.operators.spatial import mark_hubs

    ways, nodes = read_ways(spark, paths), read_nodes(spark, paths)
    if bbox:
        nodes = nodes.filter(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    used = ways.select(F.explode("refs").alias("node_id")).distinct()
    nodes = nodes.join(used, "node_id", "left_semi")
    edges = segments(ways, nodes)
    return mark_hubs(nodes, edges), edges
