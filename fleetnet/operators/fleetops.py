"""Groupings and rankings of fleets, and their last known state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetnet.functions import geo
from fleetnet.functions.geo import bearing_rad, cell, haversine_m
from fleetnet.operators.ranks import ranked_within


def latest_state(pings: DataFrame, key: str = "vehicle", order: str = "ping_id") -> DataFrame:
    """The last row of each key by order of arrival (or by event time, if ``order`` names it): a partial aggregate, no sort."""
    rest = [c for c in pings.columns if c != key]
    last = pings.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_l"))
    return last.select(key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def grid_clusters(vehicles: DataFrame, cell_deg: float = geo.FLEET_CELL, most: int = 5) -> DataFrame:
    """(id, gx, gy, cluster): clusters of up to ``most`` vehicles of one cell, in order of id."""
    rows = vehicles.select("id", cell(F.col("lon"), cell_deg).alias("gx"), cell(F.col("lat"), cell_deg).alias("gy"))
    place = F.row_number().over(Window.partitionBy("gx", "gy").orderBy("id")) - 1
    return rows.withColumn("cluster", F.floor(place / most).cast("int"))


def bearing_bins(rows: DataFrame, bins: int) -> DataFrame:
    """(dest_id, id, bearing, bin): equal numbers of each destination's vehicles in order of bearing; ``rows``: dest_id, id, lat, lon, dest_lat, dest_lon."""
    turned = rows.withColumn("bearing", F.round(bearing_rad(F.col("lat"), F.col("lon"), F.col("dest_lat"), F.col("dest_lon")), 6))
    sizes = turned.groupBy("dest_id").agg(F.count("*").alias("_n"))
    per = F.ceil(F.col("_n") / F.greatest(F.lit(1), F.least(F.lit(bins), F.col("_n"))))
    placed = ranked_within(turned, "dest_id", [F.col("bearing"), F.col("id")], "_place").join(sizes, "dest_id")
    return placed.select("dest_id", "id", "bearing", F.floor((F.col("_place") - 1) / per).cast("int").alias("bin"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the element at half the count, rounded down, of each key's values in order; no key is one task's."""
    counts = rows.select(key, value).groupBy(key, value).agg(F.count("*").alias("_n"))
    order = ranked_within(counts, key, [F.col(value)], "_r")
    # Equal values were counted together, so ranks run over distinct values and their counts are summed up along them.
    sums = _running(order, key, "_r", "_n")
    half = F.floor(F.col("_all") / 2) + 1
    return sums.filter((F.col("_upto") >= half) & (F.col("_upto") - F.col("_n") < half)).select(key, F.col(value).alias("median"))


def _running(rows: DataFrame, key: str, rank: str, n: str, block: int = 1 << 16) -> DataFrame:
    """``rows`` with _upto and _all: the sum of ``n`` up to a row in the order of ``rank``, and of all; blocks of ranks first."""
    blocks = rows.withColumn("_b", F.floor(F.col(rank) / block))
    sums = blocks.groupBy(key, "_b").agg(F.sum(n).alias("_s"))
    along = Window.partitionBy(key).orderBy("_b")
    before = sums.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), (F.sum("_s").over(along) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy(key)).alias("_all"))
    joined = blocks.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn("_upto", F.col("_before") + F.sum(n).over(Window.partitionBy(key, "_b").orderBy(rank))).drop("_b", "_k", "_c", "_before")


def outlier_split(rows: DataFrame) -> DataFrame:
    """``rows`` (dest_id, id, dist_m) with median and remote: over 250 km, or over 2.5 medians and 120 km beyond the median.

    Where fewer than eight vehicles would be left and the median is under 150 km, none is remote.
    """
    marked = rows.join(upper_median(rows, "dest_id", "dist_m"), "dest_id")
    far = (F.col("dist_m") > 250_000) | ((F.col("dist_m") > 2.5 * F.col("median")) & (F.col("dist_m") - F.col("median") > 120_000))
    marked = marked.withColumn("_far", far)
    near = marked.groupBy("dest_id").agg(F.count_if(~F.col("_far")).alias("_near"))
    return marked.join(near, "dest_id").withColumn("remote", F.col("_far") & ~((F.col("_near") < 8) & (F.col("median") < 150_000))).drop("_far", "_near")


def speed_groups(vehicles: DataFrame, together: int = 8) -> DataFrame:
    """(bucket, n, min_kmh, max_horizon_s, max_dist_m): vehicles by tens of km/h; one group of all from ``together`` vehicles on.

    ``vehicles``: kmh, horizon_s, dist_m.
    """
    total = vehicles.agg(F.count("*").alias("_n"))
    bucket = F.when(F.col("_n") >= together, F.lit(-1)).otherwise(F.floor(F.col("kmh") / 10).cast("int"))
    rows = vehicles.crossJoin(F.broadcast(total)).withColumn("bucket", bucket)  # one row
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("kmh").alias("min_kmh"), F.max("horizon_s").alias("max_horizon_s"), F.max("dist_m").alias("max_dist_m"))


def home_center(placed: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: lat, lon, the mean of the centres of the regions (see ``spatial.region_of``) that vehicles are in, and n."""
    homes = placed.select(F.col("region").alias("suffix")).distinct()
    mid = lambda k: F.avg((F.col(f"min_{k}") + F.col(f"max_{k}")) * 0.5).alias(k)
    return regions.join(homes, "suffix", "left_semi").agg(mid("lat"), mid("lon"), F.count("*").alias("n"))


def fleet_box(vehicles: DataFrame, padding_m: float) -> DataFrame:
    """One row: the box around all vehicles with a margin; nulls for an empty fleet."""
    ends = vehicles.agg(F.min("lon").alias("a"), F.min("lat").alias("b"), F.max("lon").alias("c"), F.max("lat").alias("d"))
    return ends.select(geo.expand_box(F.struct(F.col("a").alias("min_lon"), F.col("b").alias("min_lat"), F.col("c").alias("max_lon"), F.col("d").alias("max_lat")), padding_m).alias("box")).select("box.*")


def fleet_summary(vehicles: DataFrame) -> DataFrame:
    """One row for each type: vehicles, first and last time, centroid."""
    return vehicles.groupBy("vtype").agg(F.count("*").alias("n"), F.min("ts_unix").alias("first_ts"), F.max("ts_unix").alias("last_ts"), F.round(F.avg("lat"), 11).alias("lat"), F.round(F.avg("lon"), 11).alias("lon"))


def late_requests(destinations: DataFrame, vehicles: DataFrame) -> DataFrame:
    """``destinations`` with n_vehicles, latest and valid: a non-empty fleet that has reported before the deadline."""
    ends = vehicles.agg(F.count("*").alias("n_vehicles"), F.max("ts_unix").alias("latest"))
    return destinations.crossJoin(F.broadcast(ends)).withColumn("valid", (F.col("n_vehicles") > 0) & (F.col("arrive_by_unix") > F.col("latest")))


def regions_along(lines: DataFrame, regions: DataFrame, samples: int = 24) -> DataFrame:
    """(line_id, hop, region): the regions that a straight line passes, each time it enters one; ``lines``: line_id, lat0, lon0, lat1, lon1."""
    from fleetnet.operators.spatial import region_of

    points = lines.select("line_id", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("_i"), "lat0", "lon0", "lat1", "lon1")
    share = F.col("_i") / samples
    points = points.select("line_id", "_i", geo.interpolate(F.col("lat0"), F.col("lat1"), share).alias("lat"), geo.interpolate(F.col("lon0"), F.col("lon1"), share).alias("lon"))
    inside = region_of(points, regions).filter("region is not null")
    order = Window.partitionBy("line_id").orderBy("_i")
    hops = inside.withColumn("_before", F.lag("region").over(order)).filter(~F.col("region").eqNullSafe(F.col("_before")))
    return hops.select("line_id", F.row_number().over(order).alias("hop"), "region")


def thinned_hops(hops: DataFrame) -> DataFrame:
    """At most five hops of each line: the first, those at a quarter, a half and three quarters of the middle, the last."""
    n = F.count("*").over(Window.partitionBy("line_id"))
    mid = n - 2
    kept = F.array(F.lit(1), *[F.lit(2) + F.floor(mid * k / 4).cast("int") for k in (1, 2, 3)], n.cast("int"))
    rows = hops.withColumn("_keep", (n <= 5) | F.array_contains(kept.cast("array<int>"), F.col("hop")))
    order = Window.partitionBy("line_id").orderBy("hop")
    rows = rows.filter("_keep").withColumn("_before", F.lag("region").over(order)).filter(~F.col("region").eqNullSafe(F.col("_before")))
    return rows.select("line_id", F.row_number().over(order).alias("hop"), "region")


def distances(vehicles: DataFrame, destinations: DataFrame) -> DataFrame:
    """(dest_id, id, dist_m) of vehicles and the destinations for their type."""
    rows = vehicles.join(destinations.select("dest_id", "vtype", F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon")), "vtype")
    return rows.select("dest_id", "id", F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("_dlat"), F.col("_dlon")), 3).alias("dist_m"))


def unreached(vehicles: DataFrame, results: DataFrame) -> DataFrame:
    """Vehicles without a row in ``results``."""
    return vehicles.join(results.select("id"), "id", "left_anti")


def routed_or(first: DataFrame, second: DataFrame, columns: list[str], good: Column) -> DataFrame:
    """``first`` by id, its ``columns`` replaced by ``second``'s where they aren't ``good`` and second has them."""
    other = second.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    rows = first.join(other, "id", "left").withColumn("_good", F.coalesce(good, F.lit(False)))
    return rows.select("id", *[F.when(F.col("_good"), F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))).alias(c) for c in columns])
