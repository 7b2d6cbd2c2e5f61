"""Connected components of a link table, by alternating large-star and small-star contraction; of a few links in the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetnet.llm.common import cut, stored

#: Links that are joined up in the driver's Python if there are no more, counted first: 16 bytes each, 1.6 MB at most. The
#: rounds below are some dozen plans each, and what the driver's JVM keeps of plans outweighs so few rows many times.
FEW_LINKS = 100_000


def _of_few(edges: DataFrame) -> DataFrame:
    """``components`` of distinct edges (u, v), v less than u, brought together."""
    rows = edges.toArrow()
    ids, ends = np.unique(np.concatenate([rows.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    above = list(range(len(ids)))

    def root(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    for a, b in zip(*(x.tolist() for x in np.split(ends, 2)), strict=True):
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    roots = ids[np.fromiter(map(root, range(len(ids))), np.int64, len(ids))]
    return stored(edges.sparkSession.createDataFrame(pa.table({"node": ids, "root": roots})))


def _toward_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v): every node's chosen neighbours are linked to the least of them and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
    moved = near.join(least, F.col("u") == F.col("_u"))
    out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) of every node in ``links``; root is the least node of its component. Self-links and nulls count for nothing.

    A node of any degree is spread over tasks: its least neighbour comes from a partial aggregate and goes back by a
    join, which Spark splits where it is skewed. Rounds grow with the logarithm of the largest component.
    """
    edges = cut(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct())
    if dict(edges.dtypes)["u"] == "bigint" and 0 < edges.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return _of_few(edges)
    state = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state or not seen["n"]:
            break
        state = (seen["n"], seen["h"])
        edges = cut(_toward_least(_toward_least(edges, large=True), large=False))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
