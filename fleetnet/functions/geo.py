"""Geometry of points, segments, boxes, cells and tiles as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_000.0
#: Cell sizes in degrees: edges, vehicles and coarse tiles.
EDGE_CELL, FLEET_CELL, TILE_CELL = 0.02, 0.25, 0.25


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2.0), 2.0)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def to_local_m(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of an origin, on the equirectangular plane at the origin."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M, F.radians(lat - lat0) * EARTH_RADIUS_M


def from_local_m(x, y, lat0, lon0) -> tuple[Column, Column]:
    """Latitude and longitude of a point given in metres east and north of an origin."""
    x, y, lat0, lon0 = map(_c, (x, y, lat0, lon0))
    return lat0 + F.degrees(y / EARTH_RADIUS_M), lon0 + F.degrees(x / (EARTH_RADIUS_M * F.cos(F.radians(lat0))))


def along_segment(px, py, ax, ay, bx, by) -> Column:
    """Share of the way from a to b of the segment's point nearest to p; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / square
    return F.when(square > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(0.0)


def segment_distance_m(px, py, ax, ay, bx, by) -> Column:
    t = along_segment(px, py, ax, ay, bx, by)
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(dx * dx + dy * dy)


def point_segment(lat, lon, alat, alon, blat, blon) -> tuple[Column, Column]:
    """(distance in metres, share along the segment) from a point to a segment, on the plane at the point."""
    ax, ay = to_local_m(alat, alon, lat, lon)
    bx, by = to_local_m(blat, blon, lat, lon)
    zero = F.lit(0.0)
    return segment_distance_m(zero, zero, ax, ay, bx, by), along_segment(zero, zero, ax, ay, bx, by)


def lon_pad_deg(meters, lat) -> Column:
    return _c(meters) / (METERS_PER_DEGREE * F.greatest(F.lit(0.2), F.cos(F.radians(_c(lat)))))


def box(min_lon, min_lat, max_lon, max_lat) -> Column:
    return F.struct(_c(min_lon).alias("min_lon"), _c(min_lat).alias("min_lat"), _c(max_lon).alias("max_lon"), _c(max_lat).alias("max_lat"))


def expand_box(b: Column, meters) -> Column:
    """A box with a margin in metres, longitudes at the box's middle latitude."""
    dlat, dlon = _c(meters) / METERS_PER_DEGREE, lon_pad_deg(meters, (b["min_lat"] + b["max_lat"]) * 0.5)
    return box(b["min_lon"] - dlon, b["min_lat"] - dlat, b["max_lon"] + dlon, b["max_lat"] + dlat)


def segment_box(alat, alon, blat, blon, meters) -> Column:
    """The box around a segment with a margin in metres."""
    alat, alon, blat, blon = map(_c, (alat, alon, blat, blon))
    return expand_box(box(F.least(alon, blon), F.least(alat, blat), F.greatest(alon, blon), F.greatest(alat, blat)), meters)


def in_box(lat, lon, b: Column) -> Column:
    return _c(lat).between(b["min_lat"], b["max_lat"]) & _c(lon).between(b["min_lon"], b["max_lon"])


def segment_in_box(alat, alon, blat, blon, b: Column) -> Column:
    """Whether an end or the middle of a segment lies in a box."""
    alat, alon, blat, blon = map(_c, (alat, alon, blat, blon))
    return in_box(alat, alon, b) | in_box(blat, blon, b) | in_box((alat + blat) * 0.5, (alon + blon) * 0.5, b)


def cell(degrees, size: float) -> Column:
    """The number of the grid cell along one axis."""
    return F.floor(_c(degrees) / size).cast("int")


def bearing_rad(lat, lon, lat0, lon0) -> Column:
    """Angle of a point as seen from an origin, counterclockwise from east."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    return F.atan2(F.radians(lat - lat0), F.radians(lon - lon0) * F.cos(F.radians(lat0)))


def interpolate(a, b, share) -> Column:
    return _c(a) + (_c(b) - _c(a)) * _c(share)


def border_toward(lat, lon, b: Column) -> Column:
    """Where the ray from a box's centre to a target leaves the box; the target itself if it lies inside.

    A struct of lat and lon. The least positive of the ray's crossings with the four sides that lies on the box counts.
    """
    lat, lon = _c(lat), _c(lon)
    cx, cy = (b["min_lon"] + b["max_lon"]) * 0.5, (b["min_lat"] + b["max_lat"]) * 0.5
    dx, dy = lon - cx, lat - cy
    wide = lambda x: F.abs(x) > 1e-12

    def crossing(t: Column, ok: Column) -> Column:
        x, y = cx + dx * t, cy + dy * t
        inside = x.between(b["min_lon"] - 1e-6, b["max_lon"] + 1e-6) & y.between(b["min_lat"] - 1e-6, b["max_lat"] + 1e-6)
        return F.when(ok & (t > 1e-9) & inside, t)

    ts = [crossing((b[f"{side}_lon"] - cx) / F.when(wide(dx), dx), wide(dx)) for side in ("min", "max")] + [crossing((b[f"{side}_lat"] - cy) / F.when(wide(dy), dy), wide(dy)) for side in ("min", "max")]
    t = F.least(*ts)
    clamp = lambda v, low, high: F.greatest(low, F.least(high, v))
    stay = in_box(lat, lon, b)
    x = F.when(~wide(dx) & ~wide(dy), cx).when(stay, lon).when(t.isNotNull(), clamp(cx + dx * t, b["min_lon"], b["max_lon"])).otherwise(clamp(lon, b["min_lon"], b["max_lon"]))
    y = F.when(~wide(dx) & ~wide(dy), cy).when(stay, lat).when(t.isNotNull(), clamp(cy + dy * t, b["min_lat"], b["max_lat"])).otherwise(clamp(lat, b["min_lat"], b["max_lat"]))
    return F.struct(y.alias("lat"), x.alias("lon"))


def clamp_into(lat, lon, b: Column, inset: float = 0.05) -> Column:
    """A point moved into a box less an inset in degrees; a struct of lat and lon."""
    clamp = lambda v, low, high: F.least(high, F.greatest(low, v))
    return F.struct(clamp(_c(lat), b["min_lat"] + inset, b["max_lat"] - inset).alias("lat"), clamp(_c(lon), b["min_lon"] + inset, b["max_lon"] - inset).alias("lon"))


def tile_box(z: Column, x: Column, y: Column) -> Column:
    """The box of a web-mercator tile."""
    n = F.pow(F.lit(2.0), z.cast("double"))
    lon = lambda v: v / n * 360.0 - 180.0
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1.0 - 2.0 * v / n))))
    xd, yd = x.cast("double"), y.cast("double")
    return box(lon(xd), lat(yd + 1.0), lon(xd + 1.0), lat(yd))


def flipped_row(z: Column, y: Column) -> Column:
    """A tile's row counted from the other side (XYZ to TMS and back)."""
    return (F.pow(F.lit(2.0), z.cast("double")) - 1 - y).cast("bigint")


def view_box(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, share: float = 0.35, least: float = 0.06) -> Column:
    """A map view's box around points' extent: padded by a share of the span, a least number of degrees at least."""
    pad = lambda low, high: F.greatest(F.lit(least), F.greatest(high - low, F.lit(0.012)) * share)
    plat, plon = pad(min_lat, max_lat), pad(min_lon, max_lon)
    return box(min_lon - plon, min_lat - plat, max_lon + plon, max_lat + plat)


def destination_corridor_m(dist: Column, most: float) -> Column:
    """Width of the corridor between a vehicle and its destination, by bands of distance."""
    width = (
        F.when(dist < 15_000, F.greatest(F.lit(5_000.0), dist * 0.5 + 4_000))
        .when(dist < 50_000, F.greatest(F.lit(7_000.0), dist * 0.18 + 5_000))
        .when(dist < 100_000, F.greatest(F.lit(9_000.0), dist * 0.12 + 6_000))
        .when(dist > 400_000, F.lit(22_000.0))
        .otherwise(dist * 0.20 + 8_000)
    )
    return F.least(F.lit(float(most)), width)


def pair_corridor_m(dist: Column, most: float | None = None) -> Column:
    """Width of the corridor between two vehicles that may meet; ``most`` bounds it, if given."""
    width = dist * 0.35 + 12_000
    return width if most is None else F.least(F.lit(float(most)), width)


def metro_radius_m(span: Column) -> Column:
    """Radius of a metropolitan field for a fleet's span, in steps of 10 km from 80 to 150 km."""
    return F.ceil(F.least(F.lit(150_000.0), F.greatest(F.lit(80_000.0), span + 25_000)) / 10_000).cast("double") * 10_000
