"""Python workers give freed memory back after each task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

from fleetnet.llm import common


def test_freed_memory_goes_back(spark: SparkSession, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common._giving_back(lambda batches: (b * 2 for b in batches))(iter([1, 2]))) == [2, 4] and calls == [1]
    monkeypatch.undo()

    def held(batches):
        for batch in batches:
            x = pa.array([b"x" * 1000] * batch.num_rows)
            del x
            yield batch

    rows = common.map_batches(spark.range(5000), held, "id bigint").collect()
    assert sorted(r.id for r in rows) == list(range(5000))
