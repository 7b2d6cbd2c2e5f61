"""Speeds, travel times and search horizons as native column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the history's mean in a fused speed, and the speeds assumed where nothing is known.
HISTORY_SHARE, ROAD_KMH, RAIL_KMH = 0.85, 60.0, 80.0
ROAD, RAIL = 0, 1


@dataclass(frozen=True)
class Params:
    """Limits of a prediction: seconds, and a truck's driving time between rests."""

    max_time: float = 172_800.0
    truck_cycle: float = 14_400.0
    truck_rest: float = 1_800.0
    max_snap_m: float = 8_000.0


DEFAULTS = Params()


def ms(kmh) -> Column:
    return (kmh if isinstance(kmh, Column) else F.lit(float(kmh))) / 3.6


def edge_type(vtype: Column) -> Column:
    """The edge type that a vehicle may use: trains rail, others road."""
    return F.when(vtype == "train", RAIL).otherwise(ROAD)


def history_mean(samples: Column) -> Column:
    """Mean of a vehicle's speed samples; 0 without any."""
    total = F.aggregate(F.coalesce(samples, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(F.size(samples) > 0, total / F.size(samples)).otherwise(0.0)


def fused_kmh(gps: Column, history: Column, limit: Column, vtype: Column) -> Column:
    """A vehicle's speed from its GPS speed and its history's mean, capped by the limit of the edge it is on.

    Where neither is positive, 80 % of the edge's limit or else of the type's usual speed; 1 km/h at least.
    """
    gps, history = F.greatest(F.coalesce(gps, F.lit(0.0)), F.lit(0.0)), F.coalesce(history, F.lit(0.0))
    known = F.when((history > 0) & (gps > 0), history * HISTORY_SHARE + gps * (1 - HISTORY_SHARE)).when(history > 0, history).when(gps > 0, gps)
    usual = F.when(limit > 0, limit).when(vtype == "train", RAIL_KMH).otherwise(ROAD_KMH) * 0.8
    kmh = F.coalesce(known, usual)
    return F.greatest(F.when(limit > 0, F.least(kmh, limit)).otherwise(kmh), F.lit(1.0))


def with_rests(drive_s: Column, vtype: Column, p: Params = DEFAULTS) -> Column:
    """Driving seconds with a truck's rests: one after each full cycle."""
    return drive_s + F.when((vtype == "truck") & F.lit(p.truck_cycle > 0), F.floor(drive_s / max(p.truck_cycle, 1e-9)) * p.truck_rest).otherwise(0.0)


def travel_s(distance_m: Column, speed_ms: Column, vtype: Column, p: Params = DEFAULTS) -> Column:
    """Seconds for a distance, rests included; 0 without distance or speed."""
    return F.when((distance_m > 0) & (speed_ms > 0), with_rests(distance_m / speed_ms, vtype, p)).otherwise(0.0)


def edge_ms(speed_ms: Column, limit_kmh: Column) -> Column:
    """A vehicle's speed on an edge: the lower of its own and the limit, where there is one."""
    return F.when(limit_kmh > 0, F.least(speed_ms, ms(limit_kmh))).otherwise(speed_ms)


def profile_s(length_m: Column, limit_kmh: Column, kmh: float = 80.0) -> Column:
    """Seconds of an edge for the reference vehicle that routes are chosen for."""
    return length_m / edge_ms(ms(kmh), limit_kmh)


def within_pair_reach(dist: Column, a_ms: Column, b_ms: Column, p: Params = DEFAULTS) -> Column:
    """Whether two vehicles can be close enough to meet in time."""
    return dist <= (a_ms + b_ms) * p.max_time * 0.55 + 5_000


def may_arrive(dist: Column, speed_ms: Column, horizon_s: Column) -> Column:
    """Whether a vehicle can be close enough to arrive in time, by a lower bound of its travel time."""
    return (horizon_s >= 1) & (dist / (F.greatest(speed_ms, F.lit(5.0)) * 0.65) <= horizon_s + 120)


def pair_horizon_s(dist: Column, a_ms: Column, b_ms: Column, p: Params = DEFAULTS) -> Column:
    """How long two vehicles' searches for a meeting go on."""
    return F.least(F.lit(p.max_time), F.greatest(F.lit(480.0), dist / F.greatest(F.lit(5.0), F.least(a_ms, b_ms)) * 1.35 + 240))


def primary_highway(etype: Column, limit_kmh: Column, length_m: Column) -> Column:
    """Whether an edge belongs to the arterial network by itself."""
    return (etype == ROAD) & ((limit_kmh >= 60) | ((limit_kmh >= 45) & (length_m >= 400)))


def plausible_move(moved_m: Column, dt_s: Column, reuse_m: float = 1_000.0) -> Column:
    """Whether a vehicle is near enough to where it was for what was found there to hold: within ``reuse_m``, and no
    further than 50 m/s could take it in 1.5 times the time that went by."""
    return (moved_m <= reuse_m) & ((dt_s <= 0) | (moved_m <= dt_s * 75 + 500))


def request_key(lat: Column, lon: Column, width_m: Column, speed_ms: Column) -> list[Column]:
    """Whole numbers that group like requests: thousandths of a degree, kilometres of width, tens of km/h."""
    q = lambda x: F.round(x * 1000).cast("bigint")
    return [q(lat).alias("lat_q"), q(lon).alias("lon_q"), F.floor(width_m / 1000).cast("int").alias("width_q"), F.floor(speed_ms * 3.6 / 10).cast("int").alias("speed_q")]
