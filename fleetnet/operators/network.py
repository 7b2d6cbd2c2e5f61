"""Tables of the network: arcs, extracts, degrees, profiles, overlays and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetnet.functions import geo, motion
from fleetnet.storage import cut


def arcs(edges: DataFrame) -> DataFrame:
    """(node_from, node_to, edge_id, etype, length_m, limit_kmh): each edge in both directions."""
    own = edges.select("node_from", "node_to", "edge_id", "etype", "length_m", F.col("speed_kmh").alias("limit_kmh"))
    back = edges.select(F.col("node_to").alias("node_from"), F.col("node_from").alias("node_to"), "edge_id", "etype", "length_m", F.col("speed_kmh").alias("limit_kmh"))
    return own.unionByName(back)


def cheapest_arcs(arc_rows: DataFrame) -> DataFrame:
    """One arc for each two nodes and type, the one of least profile time, then of least edge."""
    weight = F.round(motion.profile_s(F.col("length_m"), F.col("limit_kmh")), 6)
    best = arc_rows.groupBy("node_from", "node_to", "etype").agg(F.min(F.struct(weight.alias("w"), "edge_id", "length_m", "limit_kmh")).alias("_b"))
    return best.select("node_from", "node_to", "etype", "_b.edge_id", "_b.length_m", "_b.limit_kmh")


def connected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select(F.col("node_id").alias("_n"))
    return edges.join(ids, F.col("node_from") == F.col("_n"), "left_semi").join(ids, F.col("node_to") == F.col("_n"), "left_semi")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates of their ends as flat, flon, tlat, tlon; edges without one are dropped."""
    end = lambda p, k: nodes.select(F.col("node_id").alias(k), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    return edges.join(end("f", "node_from"), "node_from").join(end("t", "node_to"), "node_to")


def touching(edges: DataFrame, box: Column) -> DataFrame:
    """Edges with an end in a box."""
    return edges.filter(geo.in_box(F.col("flat"), F.col("flon"), box) | geo.in_box(F.col("tlat"), F.col("tlon"), box))


def inside(edges: DataFrame, box: Column, margin_m: float = 0.0) -> DataFrame:
    """Edges with both ends in a box with a margin."""
    wide = geo.expand_box(box, margin_m) if margin_m else box
    return edges.filter(geo.in_box(F.col("flat"), F.col("flon"), wide) & geo.in_box(F.col("tlat"), F.col("tlon"), wide))


def end_nodes(edges: DataFrame) -> DataFrame:
    """The distinct node_id of edges' ends."""
    return edges.select(F.col("node_from").alias("node_id")).union(edges.select("node_to")).distinct()


def subset(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose edge_id is among ``ids``."""
    return edges.join(ids.select("edge_id"), "edge_id", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree, primary_degree): edges, and arterial edges, at each node."""
    primary = motion.primary_highway(F.col("etype"), F.col("speed_kmh"), F.col("length_m")).cast("int")
    ends = edges.select(F.explode(F.array("node_from", "node_to")).alias("node_id"), primary.alias("_p"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"), F.sum("_p").alias("primary_degree"))


def overlay(edges: DataFrame, spur_m: float = 25_000.0) -> DataFrame:
    """The arterial overlay: primary edges, roads between their nodes, and roads up to ``spur_m`` off them."""
    primary = motion.primary_highway(F.col("etype"), F.col("speed_kmh"), F.col("length_m"))
    active = end_nodes(edges.filter(primary)).select(F.col("node_id").alias("_n"))
    mark = lambda df, end: df.join(active.select(F.col("_n").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    both = mark(mark(edges, "node_from"), "node_to")
    on = lambda end: F.coalesce(F.col(f"_{end}"), F.lit(False))
    road = F.col("etype") == motion.ROAD
    keep = primary | (road & on("node_from") & on("node_to")) | (road & (F.col("length_m") <= spur_m) & (on("node_from") | on("node_to")))
    return both.filter(keep).select(*edges.columns)


def coarse_tiles(cells: DataFrame, size: float = geo.EDGE_CELL, tile: float = geo.TILE_CELL) -> DataFrame:
    """Distinct (tx, ty, edge_id): the coarse tiles that edges' cells lie in."""
    to = lambda c: F.floor(F.col(c) * size / tile).cast("int")
    return cells.select(to("gx").alias("tx"), to("gy").alias("ty"), "edge_id").distinct()


def profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and ranges of a network."""
    n = nodes.agg(
        F.count("*").alias("n_nodes"), *[F.count_if(F.col("kind") == k).alias(f"n_kind{k}") for k in range(3)],
        F.count_if(~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))).alias("n_bad_coords"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("etype") == 0).alias("n_road"), F.count_if(F.col("etype") == 1).alias("n_rail"), F.count_if(F.col("length_m") <= 0).alias("n_bad_length"))
    return n.crossJoin(e)  # one row by one row


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node reachable over ``edges``, by hooking and pointer jumping.

    Rounds grow with the logarithm of the network's diameter; each is checkpointed into the shared folder.
    """
    links = cut(edges.select(F.greatest("node_from", "node_to").alias("u"), F.least("node_from", "node_to").alias("v")).filter("u <> v").distinct())
    every = end_nodes(edges)
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
        big = both.join(least, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()
        down = big.groupBy("u").agg(F.min("v").alias("_m"))
        small = big.join(down, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(down.select("u", F.col("_m").alias("v"))).filter("u <> v").distinct()
        links = cut(small)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return every.join(links.select(F.col("u").alias("node_id"), F.col("v").alias("_r")), "node_id", "left").select("node_id", F.coalesce("_r", "node_id").alias("component"))


def component_seeds(nodes: DataFrame, labels: DataFrame, most: int = 24) -> DataFrame:
    """(component, size, lat, lon, seeds): size, centroid and the first ``most`` nodes of each component."""
    joined = labels.join(nodes.select("node_id", "lat", "lon"), "node_id")
    sizes = joined.groupBy("component").agg(F.count("*").alias("size"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    first = least_members(joined, most)
    return sizes.join(first, "component")


def least_members(labels: DataFrame, most: int) -> DataFrame:
    """(component, seeds): each component's ``most`` least nodes; ranked in lots first, so a large one isn't one task's."""
    from pyspark.sql import Window

    lot = F.pmod(F.xxhash64("node_id"), F.lit(64))
    some = labels.withColumn("_lot", lot).withColumn("_r", F.row_number().over(Window.partitionBy("component", "_lot").orderBy("node_id"))).filter(F.col("_r") <= most)
    few = some.withColumn("_r", F.row_number().over(Window.partitionBy("component").orderBy("node_id"))).filter(F.col("_r") <= most)
    return few.groupBy("component").agg(F.array_sort(F.collect_list("node_id")).alias("seeds"))


def connected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (a, b: nodes) with connected: whether one component (``labels``: node_id, component) holds both."""
    side = lambda k: labels.select(F.col("node_id").alias(k), F.col("component").alias(f"_{k}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("connected", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def bridges(nodes: DataFrame, labels: DataFrame, most_nodes: int = 48, reach_m: float = 40_000.0, size: float = geo.TILE_CELL) -> DataFrame:
    """(component, node_from, node_to, length_m): for each component of up to ``most_nodes`` nodes the shortest way to a
    node of another component, within ``reach_m``; ties go by the nodes. Only small components' nodes look around."""
    from fleetnet.operators.spatial import _around

    sizes = labels.groupBy("component").agg(F.count("*").alias("_n"))
    small = sizes.filter(F.col("_n") <= most_nodes).select("component")
    at = labels.join(nodes.select("node_id", "lat", "lon"), "node_id")
    rings = F.ceil(F.lit(reach_m) / (geo.METERS_PER_DEGREE * size * F.greatest(F.lit(0.2), F.cos(F.radians("lat"))))).cast("int")
    own = at.join(small, "component").withColumn("_c", F.explode(_around(F.col("lat"), F.col("lon"), rings, size))).select("*", "_c.gx", "_c.gy").drop("_c")
    other = at.select(F.col("node_id").alias("node_to"), F.col("component").alias("_comp"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), geo.cell(F.col("lat"), size).alias("gx"), geo.cell(F.col("lon"), size).alias("gy"))
    dist = F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), 3)
    near = own.join(other, ["gx", "gy"]).filter("component <> _comp").withColumn("_d", dist).filter(F.col("_d") <= reach_m)
    best = near.groupBy("component").agg(F.min(F.struct("_d", "node_id", "node_to")).alias("_b"))
    return best.select("component", F.col("_b.node_id").alias("node_from"), F.col("_b.node_to").alias("node_to"), F.col("_b._d").alias("length_m"))
