"""Map tiles in MBTiles files (SQLite), read as rows."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fleetnet.functions.geo import flipped_row
from fleetnet.functions.text import layer_slug


class _Zoom(InputPartition):
    pass


class TilesReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            return [_Zoom(z) for (z,) in db.execute("SELECT DISTINCT zoom_level FROM tiles ORDER BY 1")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ?", (partition.value,))


class TilesSource(DataSource):
    """``spark.read.format("mbtiles").load(path)``: z, x, row (as stored, from the south) and data; a partition a zoom."""

    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return "z INT, x INT, row INT, data BINARY"

    def reader(self, schema) -> DataSourceReader:
        return TilesReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(layer, z, x, y, data) of a file, rows counted from the north."""
    spark.dataSource.register(TilesSource)
    rows = spark.read.format("mbtiles").load(path)
    return rows.select(layer_slug(F.lit(path)).alias("layer"), "z", "x", flipped_row(F.col("z"), F.col("row")).cast("int").alias("y"), "data")
