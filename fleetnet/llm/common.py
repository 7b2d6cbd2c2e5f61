"""What the operators share: reading tables, shared storage and the word rule."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetnet.storage import cut, measured_broadcasts, shared_dir, stored  # noqa: F401  (the operators take them from here)

#: A word is a run of characters that are neither a space nor one of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

TWO_53 = float(1 << 53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_broadcasts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input that a Python operator holds at a time, and Spark's own default, which is eight times that.
BATCH_BYTES, _DEFAULT = "8m", "67108864b"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return freed memory to the system, where the C library has a call for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a Python worker, which stays for later tasks, keeps no memory that it has freed."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return given


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES, so that long documents don't add up to large ones; a session's own
    setting stands."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == _DEFAULT:
        conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(_giving_back(run), schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit(*cols: Column | str) -> Column:
    """A reproducible uniform number in [0, 1) of the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / TWO_53


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
