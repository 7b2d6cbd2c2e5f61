"""Requests in JSON, and the tables they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetnet import schemas
from fleetnet.functions.text import box_numbers, sort_key, utc_seconds


def _vehicle(v: Column) -> list[Column]:
    return [
        v["id"].alias("id"), F.when(F.lower(v["type"]) == "train", "train").otherwise("truck").alias("vtype"), v["lat"].alias("lat"), v["lon"].alias("lon"),
        v["speed"].alias("speed_kmh"), utc_seconds(F.coalesce(v["time"], v["observedAt"])).alias("ts_unix"), F.coalesce(v["history"], F.array().cast("array<double>")).alias("history"),
    ]


def _complete() -> Column:
    return F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("speed_kmh").isNotNull() & F.col("ts_unix").isNotNull()


def vehicles(requests: DataFrame, column: str = "json") -> DataFrame:
    """``requests`` parsed as one vehicle each, with valid: id, place, speed and time are there."""
    parsed = requests.withColumn("_v", F.from_json(column, schemas.VEHICLE_JSON))
    rest = [c for c in requests.columns if c != column]
    return parsed.select(*rest, *_vehicle(F.col("_v"))).withColumn("valid", _complete())


def fleets(requests: DataFrame, key: str = "request_id", column: str = "json") -> DataFrame:
    """(key, ord, vehicle columns, valid): the vehicles of each request in order. A request with a bad vehicle, or none,
    is invalid as a whole; one without any keeps a row of nulls."""
    parsed = requests.select(key, F.from_json(column, schemas.FLEET_JSON)["vehicles"].alias("_vs"))
    rows = parsed.select(key, F.posexplode_outer("_vs").alias("ord", "_v")).select(key, "ord", *_vehicle(F.col("_v"))).withColumn("_ok", _complete())
    bad = rows.groupBy(key).agg(F.bool_and("_ok").alias("valid"))
    return rows.drop("_ok").join(bad, key)


def destinations(requests: DataFrame, key: str = "request_id", column: str = "json") -> DataFrame:
    """(key, lat, lon, arrive_by_unix, vtype, sort_by, valid) of each request: the destination's own fields, not its vehicles'."""
    d = F.from_json(column, schemas.DESTINATION_JSON)
    rows = requests.select(key, d.alias("_d")).select(key, F.col("_d.lat").alias("lat"), F.col("_d.lon").alias("lon"), utc_seconds(F.col("_d.arriveBy")).alias("arrive_by_unix"), F.when(F.lower("_d.type") == "train", "train").otherwise("truck").alias("vtype"), sort_key(F.col("_d.sortBy")).alias("sort_by"))
    return rows.withColumn("valid", F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("arrive_by_unix").isNotNull())


def preloads(requests: DataFrame, key: str = "request_id", column: str = "json") -> DataFrame:
    """(key, min_lon, min_lat, max_lon, max_lat) of each preload request, from four keys or one text of four numbers."""
    p = F.from_json(column, schemas.PRELOAD_JSON)
    rows = requests.select(key, p.alias("_p")).withColumn("_b", box_numbers(F.col("_p.bbox")))
    names = {"min_lon": "minLon", "min_lat": "minLat", "max_lon": "maxLon", "max_lat": "maxLat"}
    return rows.select(key, *[F.coalesce(F.col(f"_p.{v}"), F.get("_b", i)).alias(k) for i, (k, v) in enumerate(names.items())])


def command_line_vehicles(lines: DataFrame, column: str = "line") -> DataFrame:
    """Vehicles of lines "id,lat,lon,speed,unix"; others are dropped."""
    part = F.split(F.col(column), ",")
    number = lambda i: F.trim(F.get(part, i)).try_cast("double")
    rows = lines.filter(F.size(part) == 5).select(F.trim(F.get(part, 0)).alias("id"), F.lit("truck").alias("vtype"), number(1).alias("lat"), number(2).alias("lon"), number(3).alias("speed_kmh"), number(4).cast("bigint").alias("ts_unix"))
    return rows.dropna()


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, name, priority, margin, hwy_overlay, min_lon, min_lat, max_lon, max_lat) of a region file."""
    schema = "regions ARRAY<STRUCT<suffix: STRING, name: STRING, bbox: ARRAY<DOUBLE>, margin: DOUBLE, priority: INT, hwy_overlay: BOOLEAN>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("regions").alias("r")).select("r.*")
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    return rows.select("suffix", "name", "priority", "margin", F.coalesce("hwy_overlay", F.lit(False)).alias("hwy_overlay"), *[F.get("bbox", i).alias(c) for i, c in enumerate(box)])


def places_named(places: DataFrame, query: str, most: int = 5) -> DataFrame:
    """Up to ten places whose name contains the query or is contained in it; a top report by length of name and name."""
    name, q = F.lower("name"), query.strip().lower()
    hit = name.contains(q) | F.lit(q).contains(name)
    return places.filter(hit & F.lit(bool(q))).orderBy(F.length("name"), "name").limit(min(10, max(1, most)))
