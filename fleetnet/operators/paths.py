"""Travel-time fields and shortest routes.

Times are whole milliseconds, so plus and least are exact and ties are ties. Two engines give the same rows:

* ``heap``: the arcs, if there are at most MAX_ARCS of them, are broadcast as arrays and each source's search is a heap
  search in an Arrow batch; sources are spread over the tasks.
* ``relax``: the network is cut into blocks of neighbouring node numbers; each round searches, inside every block that got
  better times from outside, as far as the block goes and hands on what crosses its border. All sources go at once, and
  rounds grow with the blocks on a way, not with its nodes. For larger networks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetnet.operators.ranks import in_order
from fleetnet.storage import cut, new_path

#: The bound of a broadcast network, which passes through the driver: 28 bytes an arc, 28 MB at most.
MAX_ARCS = 1_000_000
NO_HORIZON = (1 << 62)
#: About so many targets of a key are routed in one task; a key with more is searched from again in other tasks.
ROUTES_TOGETHER = 256


def cost_ms(length_m: Column, limit_kmh: Column, kmh: Column) -> Column:
    """Whole milliseconds of an arc at a vehicle's speed under the arc's limit, if it has one; at least one, so that no way
    goes round in a circle of arcs without length."""
    v = F.when(limit_kmh > 0, F.least(kmh, limit_kmh)).otherwise(kmh)
    return F.greatest(F.floor(length_m * 3.6e3 / v + 0.5).cast("bigint"), F.lit(1))


def seeds(places: DataFrame) -> DataFrame:
    """(id, node_id, t_ms): where searches from places start; a node at once, an edge's two ends after the way there.

    ``places``: id, edge_id (0: at node_id), node_id, along_m, length_m, node_from, node_to, kmh.
    """
    way = lambda meters: F.floor(F.greatest(meters, F.lit(0.0)) * 3.6e3 / F.col("kmh") + 0.5).cast("bigint")
    at_node = F.array(F.struct(F.col("node_id").alias("n"), F.lit(0).cast("bigint").alias("t")))
    inside = F.array(F.struct(F.col("node_from").alias("n"), way(F.col("along_m")).alias("t")), F.struct(F.col("node_to").alias("n"), way(F.col("length_m") - F.col("along_m")).alias("t")))
    rows = places.select("id", F.explode(F.when(F.col("edge_id") == 0, at_node).otherwise(inside)).alias("_s"))
    return rows.groupBy("id", F.col("_s.n").alias("node_id")).agg(F.min("_s.t").alias("t_ms"))


class Network:
    """Arcs of one type as sorted arrays, read through memory views: a search touches only the arcs that it relaxes."""

    def __init__(self, source: np.ndarray, target: np.ndarray, edge: np.ndarray, length: np.ndarray, limit: np.ndarray) -> None:
        self.ids = np.unique(np.concatenate([source, target]))
        order = np.lexsort((edge, target, source))
        row = np.searchsorted(self.ids, source[order])
        self.first = np.searchsorted(row, np.arange(len(self.ids) + 1))
        self.to, self.edge, self.length, self.limit = np.searchsorted(self.ids, target[order]).astype(np.int32), edge[order].astype(np.int64), length[order].astype(np.float64), limit[order].astype(np.float64)

    def row(self, node: int) -> int | None:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else None

    def search(self, starts: list[tuple[int, int]], kmh: float, horizon: int) -> dict[int, int]:
        """Least time of each row within the horizon, in the order of times."""
        first, to, length, limit = memoryview(self.first), memoryview(self.to), memoryview(self.length), memoryview(self.limit)
        push, pop = heapq.heappush, heapq.heappop
        best: dict[int, int] = {}
        near: dict[int, int] = {}
        heap = []
        for n, t in starts:
            r = self.row(n)
            if r is not None and t <= horizon and t < near.get(r, t + 1):
                near[r] = t
                heap.append((t, r))
        heapq.heapify(heap)
        while heap:
            t, r = pop(heap)
            if r in best:
                continue
            best[r] = t
            for a in range(first[r], first[r + 1]):
                k = to[a]
                if k in best:
                    continue
                cap = limit[a]
                u = t + (int(length[a] * 3.6e3 / (cap if 0 < cap < kmh else kmh) + 0.5) or 1)
                if u <= horizon and u < near.get(k, u + 1):
                    near[k] = u
                    push(heap, (u, k))
        return best

    def walker(self, best: dict[int, int], kmh: float):
        """A function of a row to (row, node, edge), its step towards the start: of the optimal ones the least node, then
        the least edge. Steps are kept, as routes to one start share most of them."""
        first, to, length, limit, edge, ids = (memoryview(x) for x in (self.first, self.to, self.length, self.limit, self.edge, self.ids))
        known: dict[int, tuple[int, int, int] | None] = {}

        def step(row: int) -> tuple[int, int, int] | None:
            if row not in known:
                t, found = best[row], None
                for a in range(first[row], first[row + 1]):  # arcs come in order of node and edge
                    k = to[a]
                    if k in best and best[k] + (int(length[a] * 3.6e3 / (limit[a] if 0 < limit[a] < kmh else kmh) + 0.5) or 1) == t:
                        found = (k, ids[k], edge[a])
                        break
                known[row] = found
            return known[row]

        return step


def _fits(arcs: DataFrame) -> bool:
    return arcs.limit(MAX_ARCS + 1).count() <= MAX_ARCS


def _broadcast(arcs: DataFrame):
    table = arcs.select("etype", "node_from", "node_to", "edge_id", "length_m", "limit_kmh").toArrow().to_pandas()
    nets = {int(k): Network(*(part[c].to_numpy() for c in ("node_from", "node_to", "edge_id", "length_m", "limit_kmh"))) for k, part in table.groupby("etype")}
    return arcs.sparkSession.sparkContext.broadcast(nets)


def _grouped(sources: DataFrame) -> DataFrame:
    """One row for each key: seeds, speed, edge type and horizon."""
    return sources.groupBy("key").agg(F.collect_list(F.struct("node_id", "t_ms")).alias("starts"), F.first("kmh").alias("kmh"), F.first("etype").alias("etype"), F.max(F.coalesce("horizon_ms", F.lit(NO_HORIZON))).alias("horizon_ms"))


def _tasks(jobs: DataFrame) -> int:
    """How many tasks searches are dealt to. Stated as a number: their rows are small however long they search, and without
    one, or by the key itself, which they come by already, adaptive execution puts all of them into a single task."""
    return int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def time_fields(sources: DataFrame, arcs: DataFrame, engine: str | None = None) -> DataFrame:
    """(key, node_id, t_ms, kmh, etype): least time from each key's seeds to every node within its horizon.

    ``sources``: key, node_id, t_ms, kmh, etype and horizon_ms (null: none), with one speed, type and horizon a key.
    """
    engine = engine or ("heap" if _fits(arcs) else "relax")
    return _heap_fields(sources, arcs) if engine == "heap" else relaxed_fields(sources, arcs)


def _heap_fields(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    nets = _broadcast(arcs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                net = nets.value.get(row["etype"])
                best = net.search([(s["node_id"], s["t_ms"]) for s in row["starts"]], row["kmh"], row["horizon_ms"]) if net else {}
                rows = np.fromiter(best.keys(), np.int64, len(best))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * n, pa.string()), pa.array(net.ids[rows] if n else rows), pa.array(np.fromiter(best.values(), np.int64, n)), pa.array(np.full(n, row["kmh"])), pa.array(np.full(n, row["etype"], dtype=np.int32))], names=["key", "node_id", "t_ms", "kmh", "etype"])

    jobs = _grouped(sources)
    return jobs.repartition(_tasks(jobs), F.xxhash64("key")).mapInArrow(run, "key string, node_id bigint, t_ms bigint, kmh double, etype int")


#: Nodes of a block, many where only a few keys search, as rounds grow with the blocks on a way.
BLOCK_NODES, FEW_KEYS, FEW_KEYS_NODES = 20_000, 16, 100_000
#: Keys that one task searches for in a block, about: a key that goes far counts as FAR near ones, whose horizon is NEAR_MS at most.
KEYS_TOGETHER, FAR, NEAR_MS = 512, 16, 3_600_000


def node_blocks(arcs: DataFrame, size: int = BLOCK_NODES) -> DataFrame:
    """(node_id, block): nodes in order of their numbers, ``size`` a block; near numbers are near on the ground, mostly."""
    nodes = arcs.select(F.col("node_from").alias("node_id")).union(arcs.select("node_to")).distinct()
    return in_order(nodes, [F.col("node_id")], "_pos").select("node_id", F.floor(F.col("_pos") / size).cast("bigint").alias("block"))


def _search_block(frontier: pd.DataFrame, known: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """Better times in a block, and times across its border, from the ones that came in; ``known``: the block's own."""
    nets = {int(k): Network(*(part[c].to_numpy() for c in ("node_from", "node_to", "edge_id", "length_m", "limit_kmh"))) for k, part in arcs.groupby("etype")}
    held: dict[str, dict[int, int]] = {k: {} for k in set(known["key"])}
    for k, n, t in zip(known["key"], known["node_id"].tolist(), known["t_ms"].tolist(), strict=True):
        held[k][n] = min(t, held[k].get(n, t))
    out = []
    for (key, kmh, etype, horizon), g in frontier.groupby(["key", "kmh", "etype", "horizon_ms"]):
        old = held.get(key, {})
        starts = [(n, t) for n, t in zip(g["node_id"].tolist(), g["t_ms"].tolist(), strict=True) if t < old.get(n, t + 1)]
        found = dict(starts)
        if starts and int(etype) in nets:
            net = nets[int(etype)]
            best = net.search(starts, float(kmh), int(horizon))
            found |= zip(net.ids[np.fromiter(best, np.int64, len(best))].tolist(), best.values(), strict=True)
        if old:
            found = {n: t for n, t in found.items() if t < old.get(n, t + 1)}
        n = len(found)
        out.append(pd.DataFrame({"key": key, "node_id": np.fromiter(found, np.int64, n), "t_ms": np.fromiter(found.values(), np.int64, n), "kmh": kmh, "etype": int(etype), "horizon_ms": int(horizon)}))
    return pd.concat(out)


def _least(found: DataFrame) -> DataFrame:
    """The least time of each key at each node."""
    return found.groupBy("key", "node_id").agg(F.min("t_ms").alias("t_ms"), *[F.first(c).alias(c) for c in ("kmh", "etype", "horizon_ms")])


def relaxed_fields(sources: DataFrame, arcs: DataFrame, max_rounds: int = 1_000_000, block_nodes: int | None = None) -> DataFrame:
    """``time_fields`` by blocks; fails if ``max_rounds`` don't suffice, rather than give a partial field.

    A round reads the arcs and the state of blocks with a frontier only, in lots of the keys that search there. Better times are written as further
    rows of the state, which is never written anew; of a node's rows the least time counts.
    """
    spark = sources.sparkSession
    start = cut(_least(sources.select("key", "node_id", "t_ms", "kmh", "etype", F.coalesce("horizon_ms", F.lit(NO_HORIZON)).alias("horizon_ms")).filter("t_ms <= horizon_ms")))
    block_nodes = block_nodes or (FEW_KEYS_NODES if start.select("key").distinct().limit(FEW_KEYS + 1).count() <= FEW_KEYS else BLOCK_NODES)
    blocks = cut(node_blocks(arcs, block_nodes))
    steps = cut(arcs.select("node_from", "node_to", "edge_id", "etype", "length_m", "limit_kmh").join(blocks.withColumnRenamed("node_id", "node_from"), "node_from"))
    alone = start.join(blocks, "node_id", "left_anti")  # starts off the network reach themselves only
    frontier = cut(start.join(blocks, "node_id"))
    keep = ["block", "key", "node_id", "t_ms", "kmh", "etype"]
    path, schema = new_path(spark), frontier.select(*keep).schema
    none = lambda kind: F.lit(None).cast(kind)
    weight = F.when(F.col("horizon_ms") <= NEAR_MS, 1).otherwise(FAR)

    def go(group: tuple, new: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        arc = rest["edge_id"].notna()
        known = rest.loc[~arc, ["key", "node_from", "node_to"]].set_axis(["key", "node_id", "t_ms"], axis=1)
        return _search_block(new, known, rest[arc].astype({"edge_id": "int64", "etype": "int64"})).assign(home=int(group[0]))

    for k in range(max_rounds):
        if not frontier.limit(1).count():
            state = spark.read.schema(schema).parquet(f"{path}/*") if k else frontier.select(*keep)
            done = state.groupBy("key", "node_id").agg(F.min("t_ms").alias("t_ms"), F.first("kmh").alias("kmh"), F.first("etype").alias("etype"))
            return done.unionByName(alone.select(*done.columns))
        keys = frontier.groupBy("block", "key").agg(F.max(weight).alias("_w"))
        lots = keys.groupBy("block").agg(F.ceil(F.sum("_w") / KEYS_TOGETHER).alias("_lots"))
        active = cut(keys.join(lots, "block").select("block", "key", F.pmod(F.xxhash64("key"), F.col("_lots")).alias("lot")))
        held = spark.read.schema(schema).parquet(f"{path}/*").join(active, ["block", "key"]) if k else frontier.join(active, ["block", "key"]).limit(0)
        held = held.select("block", "lot", "key", F.col("node_id").alias("node_from"), F.col("t_ms").alias("node_to"), none("bigint").alias("edge_id"), none("int").alias("etype"), none("double").alias("length_m"), none("double").alias("limit_kmh"))
        rest = steps.join(active.select("block", "lot").distinct(), "block").select("block", "lot", none("string").alias("key"), "node_from", "node_to", "edge_id", "etype", "length_m", "limit_kmh").unionByName(held)
        found = frontier.join(active, ["block", "key"]).groupBy("block", "lot").cogroup(rest.withColumnsRenamed({"block": "_block", "lot": "_lot"}).groupBy("_block", "_lot")).applyInPandas(go, "key string, node_id bigint, t_ms bigint, kmh double, etype int, horizon_ms bigint, home bigint")
        found = cut(found.join(blocks, "node_id"))
        found.filter("block = home").select(*keep).write.parquet(f"{path}/round-{k}")
        frontier = cut(_least(found.filter("block <> home")).join(blocks, "node_id"))
    raise RuntimeError(f"the field isn't complete after {max_rounds} rounds")


def field_parents(fields: DataFrame, arcs: DataFrame) -> DataFrame:
    """(key, node_id, parent_node, parent_edge, length_m, limit_kmh): the next step of each node towards its field's start.

    Of the optimal steps the least node, then the least edge; starts have no row.
    """
    here = fields.select("key", "node_id", "t_ms", "kmh", "etype")
    there = fields.select(F.col("key").alias("_key"), F.col("node_id").alias("_node"), F.col("t_ms").alias("_t"))
    step = arcs.select(F.col("node_from").alias("_from"), F.col("node_to").alias("_to"), F.col("etype").alias("_etype"), "edge_id", "length_m", "limit_kmh")
    rows = here.join(step, (F.col("node_id") == F.col("_from")) & (F.col("etype") == F.col("_etype"))).join(there, (F.col("key") == F.col("_key")) & (F.col("_to") == F.col("_node")))
    rows = rows.filter(F.col("_t") + cost_ms(F.col("length_m"), F.col("limit_kmh"), F.col("kmh")) == F.col("t_ms"))
    best = rows.groupBy("key", "node_id").agg(F.min(F.struct(F.col("_to").alias("n"), F.col("edge_id").alias("e"), "length_m", "limit_kmh")).alias("_b"))
    return best.select("key", "node_id", F.col("_b.n").alias("parent_node"), F.col("_b.e").alias("parent_edge"), "_b.length_m", "_b.limit_kmh")


def routes(sources: DataFrame, targets: DataFrame, arcs: DataFrame, engine: str | None = None) -> DataFrame:
    """(key, target, t_ms, nodes, edges): the route from each target (key, target: a node) to its key's start.

    ``nodes`` starts with the target; targets that the field doesn't reach have no row.
    """
    engine = engine or ("heap" if _fits(arcs) else "relax")
    wanted = targets.select("key", "target").distinct()
    if engine == "relax":
        return _walked(relaxed_fields(sources, arcs), wanted, arcs)
    nets = _broadcast(arcs)
    blocks = wanted.groupBy("key").agg(F.ceil(F.count("*") / ROUTES_TOGETHER).alias("_n"))
    dealt = wanted.join(blocks, "key").withColumn("_b", F.pmod(F.xxhash64("target"), F.col("_n")))
    jobs = _grouped(sources).join(dealt.groupBy("key", "_b").agg(F.collect_list("target").alias("targets")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                net = nets.value.get(row["etype"])
                best = net.search([(s["node_id"], s["t_ms"]) for s in row["starts"]], row["kmh"], row["horizon_ms"]) if net else {}
                starts = {s["node_id"]: s["t_ms"] for s in row["starts"]}
                step = net.walker(best, row["kmh"]) if net else None
                for target in row["targets"]:
                    at = net.row(target) if net else None
                    if at is None or at not in best:
                        continue
                    nodes, edges, t = [target], [], best[at]
                    while starts.get(nodes[-1]) != best[at]:
                        at, node, edge = step(at)
                        nodes.append(node)
                        edges.append(edge)
                    out.append({"key": row["key"], "target": target, "t_ms": t, "nodes": nodes, "edges": edges})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("target", pa.int64()), ("t_ms", pa.int64()), ("nodes", pa.list_(pa.int64())), ("edges", pa.list_(pa.int64()))]))

    return jobs.repartition(_tasks(jobs), F.xxhash64("key", "_b")).mapInArrow(run, "key string, target bigint, t_ms bigint, nodes array<bigint>, edges array<bigint>")


def _walked(fields: DataFrame, wanted: DataFrame, arcs: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Routes by following parents: each round takes every open route as far as its block goes."""
    fields = cut(fields)
    blocks = cut(node_blocks(arcs, block_nodes))
    lot = F.pmod(F.xxhash64("key", "target"), F.lit(max(1, -(-wanted.count() // ROUTES_TOGETHER))))
    parents = cut(field_parents(fields, arcs).join(blocks, "node_id"))
    begun = wanted.join(fields.select("key", F.col("node_id").alias("target"), "t_ms"), ["key", "target"])
    state = cut(begun.select("key", "target", "t_ms", F.col("target").alias("at"), F.array("target").alias("nodes"), F.array().cast("array<bigint>").alias("edges")))
    shape = "key string, target bigint, t_ms bigint, at bigint, nodes array<bigint>, edges array<bigint>"
    off = state.join(blocks.withColumnRenamed("node_id", "at"), "at", "left_anti").select(*state.columns)
    done, todo = [off], state.join(blocks.withColumnRenamed("node_id", "at"), "at")

    def go(group: tuple, rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        step = {(k, n): (p, e) for k, n, p, e in zip(ways["key"], ways["node_id"].tolist(), ways["parent_node"].tolist(), ways["parent_edge"].tolist(), strict=True)}
        out = []
        for key, target, t, at, nodes, edges in zip(rows["key"], rows["target"], rows["t_ms"], rows["at"], rows["nodes"], rows["edges"], strict=True):
            nodes, edges, at = list(nodes), list(edges), int(at)
            while (key, at) in step:
                at, edge = step[key, at]
                nodes.append(at)
                edges.append(edge)
            out.append((key, target, t, at, nodes, edges))
        return pd.DataFrame(out, columns=["key", "target", "t_ms", "at", "nodes", "edges"])

    while True:
        todo = cut(todo.withColumn("lot", lot))
        if not todo.limit(1).count():
            break
        active = todo.select("block", "lot", "key").distinct()
        ways = parents.join(active, ["block", "key"]).select("block", "lot", "key", "node_id", "parent_node", "parent_edge")
        moved = cut(todo.groupBy("block", "lot").cogroup(ways.withColumnsRenamed({"block": "_block", "lot": "_lot"}).groupBy("_block", "_lot")).applyInPandas(go, shape))
        there = moved.join(blocks.withColumnRenamed("node_id", "at"), "at").join(parents.select(F.col("key"), F.col("node_id").alias("at"), F.lit(True).alias("_more")), ["key", "at"], "left")
        done.append(there.filter("_more is null").select(*moved.columns))
        todo = there.filter("_more").drop("_more")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("key", "target", "t_ms", "nodes", "edges")


#: Walkers that go through a block in one task, about.
WALKS_TOGETHER = 20_000


def _walk_block(rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """``rows`` (key, id, at, kmh, road_m, drive_s) moved along ``ways`` as far as they go, a step of all of them at a time."""
    ways = ways.sort_values("node_id")
    node, parent, length, limit = (ways[c].to_numpy() for c in ("node_id", "parent_node", "length_m", "limit_kmh"))

    def row(of: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(node, of), len(node) - 1)
        return np.where(node[at] == of, at, -1)

    after = row(parent)
    at, kmh, road, drive = (rows[c].to_numpy(copy=True) for c in ("at", "kmh", "road_m", "drive_s"))
    here = row(at)
    moving = np.flatnonzero(here >= 0)
    while len(moving):
        k, v = here[moving], kmh[moving]
        road[moving] += length[k]
        drive[moving] += length[k] * 3.6 / np.where(limit[k] > 0, np.fmin(v, limit[k]), v)
        at[moving], here[moving] = parent[k], after[k]
        moving = moving[after[k] >= 0]
    return rows.assign(at=at, road_m=road, drive_s=drive)


def walked_sums(fields: DataFrame, sources: DataFrame, walkers: DataFrame, arcs: DataFrame, block_nodes: int = FEW_KEYS_NODES) -> DataFrame:
    """(key, id, exit_node, road_m, drive_s): metres and seconds of each walker's (key, id, node_id, kmh) way to its key's
    start, at its own speed under the arcs' limits, added step by step from where it starts; no route is held.

    Walkers go block by block, and many together, so a way of any length costs a few numbers.
    """
    blocks = cut(node_blocks(arcs, block_nodes))
    stops = sources.groupBy("key", "node_id").agg(F.min("t_ms").alias("t_ms"))
    going = fields.join(stops, ["key", "node_id", "t_ms"], "left_anti").select("key", "node_id")
    parents = cut(field_parents(fields, arcs).join(going, ["key", "node_id"]).join(blocks, "node_id").select("block", "key", "node_id", "parent_node", "length_m", "limit_kmh"))
    there = parents.select(F.col("key"), F.col("node_id").alias("at"), "block")
    shape = ["key", "id", "at", "kmh", "road_m", "drive_s"]
    state = walkers.select("key", "id", F.col("node_id").alias("at"), "kmh", F.lit(0.0).alias("road_m"), F.lit(0.0).alias("drive_s")).join(there, ["key", "at"], "left").select(*shape, "block")
    out = None
    while True:
        state = cut(state)
        home = state.filter("block is null").select(*shape)
        out = home if out is None else out.unionByName(home)
        todo = state.filter("block is not null")
        if not todo.limit(1).count():
            return out.select("key", "id", F.col("at").alias("exit_node"), "road_m", "drive_s")
        lots = todo.groupBy("block", "key").agg(F.ceil(F.count("*") / WALKS_TOGETHER).alias("_lots"))
        todo = todo.join(lots, ["block", "key"]).withColumn("lot", F.pmod(F.xxhash64("id"), F.col("_lots"))).drop("_lots")
        active = todo.select("block", "key", "lot").distinct()
        ways = parents.join(active, ["block", "key"]).withColumnsRenamed({"block": "_block", "key": "_key", "lot": "_lot"})
        moved = todo.select(*shape, "block", "lot").groupBy("block", "key", "lot").cogroup(ways.groupBy("_block", "_key", "_lot")).applyInPandas(lambda rows, ways: _walk_block(rows[["key", "id", "at", "kmh", "road_m", "drive_s"]], ways), "key string, id string, at bigint, kmh double, road_m double, drive_s double")
        state = moved.join(there, ["key", "at"], "left").select(*shape, "block")


def times_at(fields: DataFrame, places: DataFrame) -> DataFrame:
    """(key, id, t_ms): each field's time at each place, over the nearer end of its edge; unreached places have no row.

    ``places``: see ``seeds``; the way between an end and the place is at the place's kmh.
    """
    ends = seeds(places).select("id", F.col("node_id").alias("_n"), F.col("t_ms").alias("_off"))
    return fields.join(ends, F.col("node_id") == F.col("_n")).groupBy("key", "id").agg(F.min(F.col("t_ms") + F.col("_off")).alias("t_ms"))


def position_after(fields: DataFrame) -> DataFrame:
    """(key, node_id, t_ms): where each key is at the end of its fields' horizon: the node of the largest time, of equal
    ones the least node."""
    last = fields.groupBy("key").agg(F.max(F.struct("t_ms", (-F.col("node_id")).alias("_n"))).alias("_l"))
    return last.select("key", (-F.col("_l._n")).alias("node_id"), F.col("_l.t_ms").alias("t_ms"))
