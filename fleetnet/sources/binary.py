"""Networks in the fixed-width binary format: a header, node records, edge records.

Little-endian. Header: 8 bytes of magic, version (int32), node count, edge count (int64). Node: id (int64), lat, lon
(double), kind (int32). Edge: id, from, to (int64), type (int32), length, limit (double). Only version 1 is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fleetnet import schemas

HEADER = np.dtype([("magic", "S8"), ("version", "<i4"), ("nodes", "<i8"), ("edges", "<i8")])
NODES = np.dtype([("node_id", "<i8"), ("lat", "<f8"), ("lon", "<f8"), ("kind", "<i4")])
EDGES = np.dtype([("edge_id", "<i8"), ("node_from", "<i8"), ("node_to", "<i8"), ("etype", "<i4"), ("length_m", "<f8"), ("speed_kmh", "<f8")])
#: Records of one input partition.
CHUNK = 1_000_000


class _Range(InputPartition):
    def __init__(self, start: int, count: int, offset: int) -> None:
        super().__init__((start, count))
        self.count, self.at = count, offset + start


class NetworkReader(DataSourceReader):
    def __init__(self, options: dict, kind: np.dtype) -> None:
        self.path, self.kind, self.magic = options["path"], kind, options.get("magic")

    def header(self) -> np.void:
        with open(self.path, "rb") as f:
            head = np.frombuffer(f.read(HEADER.itemsize), dtype=HEADER)[0]
        if head["version"] != 1 or (self.magic and head["magic"] != self.magic.encode()):
            raise ValueError(f"{self.path}: not a network file of version 1")
        return head

    def partitions(self) -> list[InputPartition]:
        head = self.header()
        edges = self.kind is EDGES
        offset = HEADER.itemsize + (int(head["nodes"]) * NODES.itemsize if edges else 0)
        n = int(head["edges" if edges else "nodes"])
        return [_Range(0, min(CHUNK, n - k), offset + k * self.kind.itemsize) for k in range(0, n, CHUNK)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(partition.at)
            rows = np.frombuffer(f.read(partition.count * self.kind.itemsize), dtype=self.kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in rows.dtype.names], names=list(rows.dtype.names))


class NetworkSource(DataSource):
    """``spark.read.format("fleetnet").option("table", "node" or "edge").load(path)``; the path must be readable by every
    executor as a local file. Option ``magic``: the file's first eight bytes, checked if given."""

    @classmethod
    def name(cls) -> str:
        return "fleetnet"

    def schema(self) -> str:
        return schemas.EDGE if self.options.get("table", "node") == "edge" else schemas.NODE

    def reader(self, schema) -> DataSourceReader:
        return NetworkReader(self.options, EDGES if self.options.get("table", "node") == "edge" else NODES)


def read(spark: SparkSession, path: str, magic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a binary file; edges that lack an end are dropped."""
    from fleetnet.operators.network import connected_edges

    spark.dataSource.register(NetworkSource)
    load = lambda table: (r.option("magic", magic) if magic else r).option("table", table).load(path) if (r := spark.read.format("fleetnet")) else None
    nodes, edges = load("node"), load("edge")
    return nodes, connected_edges(edges, nodes)


def write(nodes: DataFrame, edges: DataFrame, path: str, magic: str = "NETWORK1") -> None:
    """Write one file, records in order of id. Rows stream through the driver a partition at a time; for large networks
    keep Parquet (see ``operators.export.write_network``)."""
    import os

    n, e = nodes.count(), edges.count()
    with open(f"{path}.tmp", "wb") as f:
        f.write(np.array([(magic.encode(), 1, n, e)], dtype=HEADER).tobytes())
        for table, kind, key in ((nodes, NODES, "node_id"), (edges, EDGES, "edge_id")):
            for row in table.select(*kind.names).orderBy(key).toLocalIterator():
                f.write(np.array([tuple(row)], dtype=kind).tobytes())
    os.replace(f"{path}.tmp", path)
