"""Strings of requests and results: speeds, boxes, times, labels and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def maxspeed_kmh(tag: Column) -> Column:
    """Kilometres per hour of a speed tag: a number, with mph, km/h, kph or kmh after it; anything else 0."""
    tag = F.lower(F.trim(tag))
    number = lambda pattern: F.regexp_extract(tag, pattern, 1).try_cast("double")
    mph = number(r"^([+-]?[0-9.]+)\s*mph$") * 1.60934
    metric = number(r"^([+-]?[0-9.]+)(?:\s.*)?$")
    joined = number(r"^([+-]?[0-9.]+)\s*kmh$")
    return F.coalesce(F.when(tag.endswith("mph"), mph).when(tag.endswith("kmh"), joined).otherwise(metric), F.lit(0.0))


def box_numbers(text: Column) -> Column:
    """The four numbers of "min_lon,min_lat,max_lon,max_lat" as an array; null if there are not four."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull()), parts)


def utc_seconds(text: Column) -> Column:
    """Unix seconds of an ISO time read as UTC: T or a space between, seconds optional, fraction and a Z dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"[zZ]$", ""), r"\.\d*$", ""), "T", " ")
    whole = F.when(F.length(bare) == 16, F.concat(bare, F.lit(":00"))).otherwise(bare)
    return F.unix_timestamp(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss")))


def utc_text(seconds: Column) -> Column:
    """Unix seconds as yyyy-MM-ddTHH:mm:ssZ, fractions cut off downwards."""
    return F.from_unixtime(F.floor(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sort_key(text: Column) -> Column:
    """The arrivals' order that a request's word names: eta, distance or (anything else) duration."""
    return F.when(text.isin("eta", "arrival", "arrive"), "eta").when(text.isin("distance", "route", "routeDistance"), "distance").otherwise("duration")


def location_id(node_id: Column, edge_id: Column) -> Column:
    """The name of a place on the network: the node's number, or edge:<number> inside an edge."""
    return F.when(F.coalesce(edge_id, F.lit(0)) == 0, node_id.cast("string")).otherwise(F.concat(F.lit("edge:"), edge_id.cast("string")))


def regional_path(path: Column, suffix: Column, extensions: str = r"(\.[A-Za-z0-9]+)*$") -> Column:
    """A national file's name with a region's suffix before its extensions."""
    ext = F.regexp_extract(path, rf"[^/.]({extensions[:-1]})$", 1)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(ext)), F.lit("_"), suffix, ext)


def action_kind(json: Column) -> Column:
    """What a request asks for: preload, destination, lead or vehicle; by its action, else by the keys it has."""
    action = F.coalesce(F.get_json_object(json, "$.action"), F.lit(""))
    has = lambda p: F.get_json_object(json, p).isNotNull()
    return (
        F.when(action.contains("preload"), "preload")
        .when(action.isin("destination_arrival", "destinationArrival") | (has("$.arriveBy") & has("$.lat")), "destination")
        .when(action.isin("meet_with_lead", "meetWithLead") | has("$.vehicles[0].id"), "lead")
        .otherwise("vehicle")
    )


def layer_slug(path: Column) -> Column:
    """A layer's name of a file's: lower case, without folder and extension, other characters than letters, digits, - and _ replaced."""
    base = F.regexp_replace(F.regexp_extract(F.lower(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_-]", "_"), r"^_+|_+$", "")
    return F.when(slug == "", "layer").otherwise(slug)
