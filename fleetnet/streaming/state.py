"""The fleet's last known state as a stream, and what is answered from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetnet.functions.geo import FLEET_CELL, cell, view_box

#: (id, seq, vtype, lat, lon, speed_kmh, ts_unix, history): ``seq`` numbers arrivals; the last one wins, whatever its time.
STATE = "id STRING, seq BIGINT, vtype STRING, lat DOUBLE, lon DOUBLE, speed_kmh DOUBLE, ts_unix BIGINT, history ARRAY<DOUBLE>, removed BOOLEAN"
_FIELDS = ["seq", "vtype", "lat", "lon", "speed_kmh", "ts_unix", "history", "removed"]


def _upsert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("seq")
    seq, history = (state.get[0], state.get[6]) if state.exists else (-1, None)
    samples = [h for h in rows["history"] if h is not None and len(h)]
    last = rows.iloc[-1]
    if last["seq"] < seq:
        last_row = None
    else:
        history = list(samples[-1]) if samples else history  # an empty history keeps the one before
        gone = bool(last["removed"])  # a removed vehicle leaves its seq behind, so no older row brings it back, and no history
        last_row = (int(last["seq"]), last["vtype"], float(last["lat"]), float(last["lon"]), float(last["speed_kmh"]), int(last["ts_unix"]), [float(x) for x in history] if history is not None and not gone else [], gone)
        state.update(last_row)
    if last_row is not None:
        yield pd.DataFrame([[key[0], *last_row]], columns=["id", *_FIELDS])


def latest_vehicles(stream: DataFrame) -> DataFrame:
    """An update stream of each vehicle's state after each micro-batch: upserts by id; of a row marked removed, only
    its seq stays."""
    rows = stream.select("id", *[F.col(c) if c in stream.columns else F.lit(None).cast("array<double>" if c == "history" else "boolean").alias(c) for c in _FIELDS])
    rows = rows.withColumn("removed", F.coalesce("removed", F.lit(False)))
    return rows.groupBy("id").applyInPandasWithState(_upsert, STATE, STATE.split(", ", 1)[1], "update", GroupStateTimeout.NoTimeout)


def merge_latest(table: DataFrame, batch: DataFrame) -> DataFrame:
    """A state table after a batch of rows like it, by the last seq; a history that is empty keeps the one before.

    Removed vehicles stay as rows marked removed, without a history, so that no older row brings them back; ``present``
    has the others.
    """
    both = table.unionByName(batch)
    last = both.groupBy("id").agg(F.max_by(F.struct(*[f for f in _FIELDS if f != "history"]), "seq").alias("_l"), F.max(F.when(F.col("removed"), F.col("seq"))).alias("_gone"), F.array_sort(F.collect_set(F.when(F.size("history") > 0, F.struct("seq", "history")))).alias("_h"))
    own = F.filter("_h", lambda h: F.col("_gone").isNull() | (h["seq"] > F.col("_gone")))  # the histories since it was removed
    history = F.coalesce(F.element_at(F.when(F.size(own) > 0, own), -1)["history"], F.array().cast("array<double>"))
    return last.select("id", *[F.col(f"_l.{f}").alias(f) for f in _FIELDS if f != "history"], history.alias("history")).select("id", *_FIELDS)


def present(table: DataFrame) -> DataFrame:
    """The vehicles of a state table that haven't been removed."""
    return table.filter(~F.col("removed"))


def cell_changes(before: DataFrame, after: DataFrame, size: float = FLEET_CELL) -> DataFrame:
    """(id, change, gx, gy, old_gx, old_gy): what two state tables mean for a grid index: inserts, moves to another cell and
    removals; vehicles that stay in their cell have no row."""
    own = lambda t, x, y: present(t).select("id", cell(F.col("lat"), size).alias(x), cell(F.col("lon"), size).alias(y))
    both = own(before, "old_gx", "old_gy").join(own(after, "gx", "gy"), "id", "full_outer")
    change = F.when(F.col("old_gx").isNull(), "insert").when(F.col("gx").isNull(), "remove").when((F.col("gx") != F.col("old_gx")) | (F.col("gy") != F.col("old_gy")), "move")
    return both.select("id", change.alias("change"), "gx", "gy", "old_gx", "old_gy").filter("change is not null")


def map_snapshot(table: DataFrame, page: int = 10_000) -> DataFrame:
    """(vtype, page, vehicles, view): the present vehicles for a map, up to ``page`` a row, and the box that shows a type's."""
    here = present(table)
    ends = here.groupBy("vtype").agg(F.min("lat").alias("_a"), F.min("lon").alias("_b"), F.max("lat").alias("_c"), F.max("lon").alias("_d"), F.count("*").alias("_n"))
    paged = here.join(ends.select("vtype", "_n"), "vtype").withColumn("page", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / page)).cast("int"))
    lists = paged.groupBy("vtype", "page").agg(F.array_sort(F.collect_list(F.struct("id", "lat", "lon", "speed_kmh", "ts_unix"))).alias("vehicles"))
    return lists.join(ends, "vtype").select("vtype", "page", "vehicles", view_box(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d")).alias("view"))


def answer_each_batch(stream: DataFrame, answer: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch of changed vehicles to ``answer`` (state rows, batch number)."""
    return latest_vehicles(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(answer).start()


def windowed_speeds(pings: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(vehicle, start, n, mean_kmh) by event-time windows; with ``late``, under a watermark, so it also runs on a stream."""
    rows = pings.withWatermark("ts", late) if late else pings
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy("vehicle", w.alias("_w")).agg(F.count("*").alias("n"), F.round(F.avg("speed_kmh"), 11).alias("mean_kmh")).select("vehicle", F.col("_w.start").alias("start"), "n", "mean_kmh")


def trips(pings: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(vehicle, start, stop, n): runs of pings with gaps up to ``gap``."""
    w = F.session_window("ts", gap)
    return pings.groupBy("vehicle", w.alias("_w")).agg(F.count("*").alias("n")).select("vehicle", F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), "n")
