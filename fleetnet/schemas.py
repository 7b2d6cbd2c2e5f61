"""Schemas of the engine's tables and of the requests it reads."""

from __future__ import annotations

NODE = "node_id BIGINT, lat DOUBLE, lon DOUBLE, kind INT"
EDGE = "edge_id BIGINT, node_from BIGINT, node_to BIGINT, etype INT, length_m DOUBLE, speed_kmh DOUBLE"
VEHICLE = "id STRING, vtype STRING, lat DOUBLE, lon DOUBLE, speed_kmh DOUBLE, ts_unix BIGINT"

#: Kinds of nodes.
JUNCTION, STATION, HUB = 0, 1, 2

VEHICLE_JSON = "id STRING, type STRING, lat DOUBLE, lon DOUBLE, speed DOUBLE, time STRING, observedAt STRING, history ARRAY<DOUBLE>"
FLEET_JSON = f"action STRING, vehicles ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in VEHICLE_JSON.split(', '))}>>"
DESTINATION_JSON = f"action STRING, lat DOUBLE, lon DOUBLE, arriveBy STRING, type STRING, sortBy STRING, vehicles ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in VEHICLE_JSON.split(', '))}>>"
PRELOAD_JSON = "action STRING, minLon DOUBLE, minLat DOUBLE, maxLon DOUBLE, maxLat DOUBLE, bbox STRING"
