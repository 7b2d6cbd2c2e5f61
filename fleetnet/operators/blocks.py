"""Many corridors against many edges without a row for each pair or cell: by blocks of the map, and inside a block by halves.

A box of edges that lies wholly in a corridor is taken at once, and one wholly outside is left; only boxes that a corridor's
border crosses are halved, across the corridors' direction, until few edges are left, which are tried one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetnet.functions import geo

R = geo.EARTH_RADIUS_M
#: A block's size in degrees, the edges and corridors that one task takes of it, and the pairs that are tried one by one.
BLOCK, EDGES_TOGETHER, CORRIDORS_TOGETHER, TRIED = 5.12, 60_000, 200_000, 20_000
#: Boxes nearer to a border than this, in metres, are halved, whatever rounding says.
SLACK = 1e-3


class Corridors:
    """Segments a-b as arrays in radians, with their width in metres."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.a_lat, self.a_lon, self.b_lat, self.b_lon, self.width = (rows[c].to_numpy(np.float64) for c in ("a_lat", "a_lon", "b_lat", "b_lon", "width_m"))
        self.y, self.x = np.radians(self.a_lat) * R, np.radians(self.a_lon)
        self.dy, self.dx = np.radians(self.b_lat - self.a_lat) * R, np.radians(self.b_lon - self.a_lon)

    def near_box(self, k: np.ndarray, box: tuple[float, float, float, float], reach: np.ndarray):
        """Which of the corridors ``k`` come within ``reach`` of a box (least and most latitude, least and most longitude),
        which may hold it wholly, and how far the box spreads across them, by longitude and by latitude.

        East-west distances at the box's shortest degree are no longer than a point's own, so none that is near is lost.
        """
        low, _ = _easts(box[0], box[1])
        y, x = np.radians(box[0] + box[1]) * 0.5 * R, np.radians(box[2] + box[3]) * 0.5
        hy, hx = np.radians(box[1] - box[0]) * 0.5 * R, np.radians(box[3] - box[2]) * 0.5 * low
        dx, dy = self.dx[k] * low, self.dy[k]
        length = np.hypot(dx, dy)
        some = length > 1e-4
        ux, uy = np.where(some, dx / np.where(some, length, 1.0), 1.0), np.where(some, dy / np.where(some, length, 1.0), 0.0)
        px, py = (x - self.x[k]) * low, y - self.y[k]
        across, along = np.abs(px * uy - py * ux), px * ux + py * uy
        ux, uy = np.abs(ux), np.abs(uy)
        spread_x, spread_y = uy * hx, ux * hy
        wide, far = spread_x + spread_y, ux * hx + uy * hy
        near = (across - wide <= reach + SLACK) & (along + far >= -reach - SLACK) & (along - far <= length + reach + SLACK)
        return near, across + wide <= self.width[k], spread_x, spread_y

    def holds(self, k: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
        """Which of the corridors ``k`` surely hold a box: its corners are inside even at its longest degree."""
        _, high = _easts(box[0], box[1])
        dx, dy = self.dx[k] * high, self.dy[k]
        square = dx * dx + dy * dy
        inside = np.ones(len(k), bool)
        for lat in box[:2]:
            for lon in box[2:]:
                px, py = (np.radians(lon) - self.x[k]) * high, np.radians(lat) * R - self.y[k]
                t = np.where(square > 1e-9, np.clip((px * dx + py * dy) / np.where(square > 1e-9, square, 1.0), 0.0, 1.0), 0.0)
                inside &= np.hypot(px - t * dx, py - t * dy) <= self.width[k] - SLACK
        return inside

    def exact(self, k: np.ndarray, lat: np.ndarray, lon: np.ndarray, east: np.ndarray) -> np.ndarray:
        """Whether each point (a row) lies in each corridor of ``k`` (a column), step by step as in ``spatial._near_squared``."""
        lat, lon, east = lat[:, None], lon[:, None], east[:, None]
        ax, ay = np.radians(self.a_lon[k] - lon) * east, np.radians(self.a_lat[k] - lat) * R
        dx, dy = self.dx[k] * east, self.dy[k]
        square = dx * dx + dy * dy
        some = square > 1e-9
        t = np.where(some, np.clip(-(ax * dx + ay * dy) / np.where(some, square, 1.0), 0.0, 1.0), 0.0)
        x, y = ax + t * dx, ay + t * dy
        return x * x + y * y <= self.width[k] * self.width[k]


def _easts(low: float, high: float) -> tuple[float, float]:
    """The least and the most metres of a radian of longitude between two latitudes."""
    ends = np.abs(np.cos(np.radians([low, high])))
    turns = lambda at: np.floor((low - at) / 180.0) != np.floor((high - at) / 180.0)
    return (0.0 if turns(90.0) else float(ends.min()) * R * (1 - 1e-12)), (1.0 if turns(0.0) else float(ends.max())) * R * (1 + 1e-12)


def _halves(p: np.ndarray, lat: np.ndarray, lon: np.ndarray, by_lon: bool) -> list[np.ndarray]:
    """``p`` cut in the middle of its longitudes or latitudes, of the others where those are all equal."""
    for v in (lon[p], lat[p]) if by_lon else (lat[p], lon[p]):
        low, high = v.min(), v.max()
        left = v < low + (high - low) * 0.5
        if left.any() and not left.all():
            return [p[left], p[~left]]
    return []


def counted(points: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """(corridor_id, n_edges, first_edge, edge_sum) of the edges (edge_id, lat, lon: their middle, east) in each corridor."""
    lat, lon, east = (points[c].to_numpy(np.float64) for c in ("lat", "lon", "east"))
    edge, cor = points["edge_id"].to_numpy(np.int64), Corridors(rows)
    n, total, first = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max)
    todo = [(np.arange(len(points)), np.arange(len(rows)))]
    while todo:
        p, k = todo.pop()
        box = lat[p].min(), lat[p].max(), lon[p].min(), lon[p].max()
        near, maybe, spread_x, spread_y = cor.near_box(k, box, cor.width[k])
        maybe &= near
        held = k[maybe][cor.holds(k[maybe], box)]
        n[held] += len(p)
        total[held] += edge[p].sum()
        first[held] = np.minimum(first[held], edge[p].min())
        near[np.flatnonzero(maybe)[np.isin(k[maybe], held, assume_unique=True)]] = False
        k, by_lon = k[near], spread_x[near].sum() >= spread_y[near].sum()
        if not len(k):
            continue
        parts = _halves(p, lat, lon, by_lon) if len(p) > 4 and len(p) * len(k) > TRIED else []
        todo += [(part, k) for part in parts]
        for at in [] if parts else range(0, len(p), 8):  # no more than a few points at once
            q = p[at : at + 8]
            hit = cor.exact(k, lat[q], lon[q], east[q])
            n[k] += hit.sum(axis=0)
            total[k] += edge[q] @ hit
            first[k] = np.minimum(first[k], np.where(hit, edge[q][:, None], np.iinfo(np.int64).max).min(axis=0))
    some = n > 0
    return pd.DataFrame({"corridor_id": rows["corridor_id"].to_numpy()[some], "n_edges": n[some], "first_edge": first[some], "edge_sum": total[some]})


def _haversine_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    half = lambda a, b: np.sin(np.radians(b - a) / 2.0) ** 2.0
    h = half(lat1, lat2) + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half(lon1, lon2)
    return 2.0 * R * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def covered(edges: pd.DataFrame, rows: pd.DataFrame, keep_m: float | None = None) -> np.ndarray:
    """Which edges (flat, flon, tlat, tlon, and the cells gx0.. of both ends and the middle) a corridor has: with a cell in
    its box of cells (x0, x1, y0, y1) and the middle in it; with ``keep_m`` also by an end in it, or any of the three points
    within ``keep_m`` of one of its ends. The first corridor that has an edge ends its search."""
    lats, lons = (np.stack([edges[f"f{c}"], edges[f"t{c}"], (edges[f"f{c}"] + edges[f"t{c}"]) * 0.5]) for c in ("lat", "lon"))
    easts = np.cos(np.radians(lats)) * R
    gx, gy = (np.stack([edges[f"{c}{i}"] for i in range(3)]) for c in ("gx", "gy"))
    cor, box = Corridors(rows), {c: rows[c].to_numpy(np.int64) for c in ("x0", "x1", "y0", "y1")}
    used = [2] if keep_m is None else [0, 1, 2]
    found, lat, lon = np.zeros(len(edges), bool), lats[2], lons[2]
    keep_deg = None if keep_m is None else np.degrees(keep_m / R) * (1 + 1e-9)
    todo = [(np.arange(len(edges)), np.arange(len(rows)))]
    while todo:
        p, k = todo.pop()
        x0, x1, y0, y1 = gx[:, p].min(), gx[:, p].max(), gy[:, p].min(), gy[:, p].max()
        k = k[(box["x0"][k] <= x1) & (box["x1"][k] >= x0) & (box["y0"][k] <= y1) & (box["y1"][k] >= y0)]
        b = lats[used][:, p].min(), lats[used][:, p].max(), lons[used][:, p].min(), lons[used][:, p].max()
        near, _, spread_x, spread_y = cor.near_box(k, b, cor.width[k])
        if keep_m is not None:
            for end in (cor.a_lat[k], cor.b_lat[k]):
                near |= (end >= b[0] - keep_deg) & (end <= b[1] + keep_deg)
        k, by_lon = k[near], spread_x[near].sum() >= spread_y[near].sum()
        if not len(k):
            continue
        mid = lat[p].min(), lat[p].max(), lon[p].min(), lon[p].max()
        whole = k[(box["x0"][k] <= gx[2, p].min()) & (box["x1"][k] >= gx[2, p].max()) & (box["y0"][k] <= gy[2, p].min()) & (box["y1"][k] >= gy[2, p].max())]
        if cor.holds(whole, mid).any():
            found[p] = True
            continue
        parts = _halves(p, lat, lon, by_lon) if len(p) > 4 and len(p) * len(k) > TRIED else []
        todo += [(part, k) for part in parts]
        for at in [] if parts else range(0, len(p), 8):
            q = p[at : at + 8]
            fits = np.zeros((len(q), len(k)), bool)
            for i in range(3):
                fits |= (gx[i, q][:, None] >= box["x0"][k]) & (gx[i, q][:, None] <= box["x1"][k]) & (gy[i, q][:, None] >= box["y0"][k]) & (gy[i, q][:, None] <= box["y1"][k])
            hit = np.zeros_like(fits)
            for i in used:
                hit |= cor.exact(k, lats[i, q], lons[i, q], easts[i, q])
            hit &= fits
            if keep_m is not None:
                for i in used:
                    for end_lat, end_lon in ((cor.a_lat[k], cor.a_lon[k]), (cor.b_lat[k], cor.b_lon[k])):
                        r, c = np.nonzero(fits & ~hit.any(axis=1)[:, None] & (np.abs(lats[i, q][:, None] - end_lat) <= keep_deg))
                        close = _haversine_m(lats[i, q][r], lons[i, q][r], end_lat[c], end_lon[c]) <= keep_m
                        hit[r[close], c[close]] = True
            found[q] |= hit.any(axis=1)
    return found


def _dealt(rows: DataFrame, key: str, together: int, lot: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``lot``, lots of about ``together`` rows of a block, and (gx, gy, the lots of each block)."""
    sizes = rows.groupBy("gx", "gy").agg(F.ceil(F.count("*") / together).alias("_n"))
    lots = sizes.select("gx", "gy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias(lot))
    return rows.join(sizes, ["gx", "gy"]).withColumn(lot, F.pmod(F.xxhash64(key), F.col("_n"))).drop("_n"), lots


def by_blocks(edges: DataFrame, corridors: DataFrame, go, shape: str) -> DataFrame:
    """``go(edges, corridors)`` for each block of ``edges`` and ``corridors`` (with gx, gy: the block's numbers)."""
    mine, my_lots = _dealt(edges, "edge_id", EDGES_TOGETHER, "lot")
    theirs, their_lots = _dealt(corridors, "corridor_id", CORRIDORS_TOGETHER, "share")
    left = mine.join(their_lots, ["gx", "gy"]).groupBy("gx", "gy", "lot", "share")
    right = theirs.join(my_lots, ["gx", "gy"]).withColumnsRenamed({"gx": "_gx", "gy": "_gy", "lot": "_lot", "share": "_share"})
    return left.cogroup(right.groupBy("_gx", "_gy", "_lot", "_share")).applyInPandas(lambda e, c: go(e, c) if len(e) and len(c) else go(e.head(0), c.head(0)), shape)


def corridor_blocks(corridors: DataFrame, blocks: DataFrame) -> DataFrame:
    """``corridors`` with the numbers gx, gy of those ``blocks`` that have a point within their width, and maybe some more."""
    pad = F.degrees(F.col("width_m") / R) * (1 + 1e-9)
    rows = F.sequence(geo.cell(F.least("a_lat", "b_lat") - pad, BLOCK), geo.cell(F.greatest("a_lat", "b_lat") + pad, BLOCK))
    placed = corridors.withColumn("gx", F.explode(rows)).join(blocks, "gx")
    low, high = F.col("gx") * BLOCK, (F.col("gx") + 1) * BLOCK
    turns = F.floor((low - 90.0) / 180.0) != F.floor((high - 90.0) / 180.0)
    cos = lambda v: F.abs(F.cos(F.radians(v)))
    side: Column = F.degrees(F.col("width_m") / (R * F.when(turns, 0.0).otherwise(F.least(cos(low), cos(high))) + 1e-6)) * (1 + 1e-9)
    return placed.filter(((F.col("gy") + 1) * BLOCK >= F.least("a_lon", "b_lon") - side) & (F.col("gy") * BLOCK <= F.greatest("a_lon", "b_lon") + side))
