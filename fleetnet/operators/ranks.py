"""Positions in a global order and ranks inside groups of any size: a group that holds most of the rows is ranked by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetnet.storage import stored

#: Bits of a row's number inside its partition, as Spark numbers rows.
_OWN = 33


def in_order(rows: DataFrame, order: list[Column], name: str = "_pos", total: str | None = None) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... in the order of ``order``, nulls first; ``total``: a column of the number of rows.

    Rows are dealt by ranges of ``order`` and sorted in their range; the sorted rows are stored once, as ranges come from a
    sample, and a range's numbers start after those of the ranges before it. Only a row for each range is summed up in
    one place. Rows that are equal in ``order`` stay in one range, so it should tell rows apart.
    """
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    dealt = rows.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()))
    span = F.shiftright("_at", _OWN)
    sizes = dealt.groupBy(span.alias("_span")).agg(F.count("*").alias("_n"))  # a row for each partition
    along = Window.orderBy("_span")
    before = sizes.select("_span", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    placed = dealt.join(F.broadcast(before), span == F.col("_span"))
    placed = placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _OWN) - 1)))
    return (placed.withColumn(total, F.col("_total")) if total else placed).drop("_at", "_span", "_before", "_total")


def ranked_within(rows: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in each group of column ``by``, by rising ``order``, nulls first."""
    placed = in_order(rows, [F.col(by), *order], "_pos")
    first = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_pos").alias("_first"))
    return placed.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, (F.col("_pos") - F.col("_first") + 1).cast("int")).drop("_pos", "_by", "_first")
