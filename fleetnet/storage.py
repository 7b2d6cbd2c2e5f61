"""Reliable cuts of lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_PLANNED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def measured_broadcasts(spark: SparkSession) -> None:
    """Let a join's side be sent to the driver and all executors by its measured size only, under the session's own bound.

    A plan's guess is the size of compressed files, and takes no account of rows that an explode makes: a table of a
    million rows passes for a small one. Joins that ask for a broadcast still get it.
    """
    conf = spark.conf
    if conf.get(_MEASURED, None) is None and conf.get("spark.sql.adaptive.enabled") == "true":
        conf.set(_MEASURED, conf.get(_PLANNED))
        conf.set(_PLANNED, "-1")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and all tasks run in the driver's machine."""
    measured_broadcasts(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="fleetnet-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into the shared folder, as a table of unknown size.

    A checkpoint keeps its plan's guess of bytes, and a join's guess is the product of its sides': over the rounds of a
    loop its digits double with each join, until the number alone fills the driver's memory.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().analyzed().rdd(), kept.schema(), False), spark)


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fleetnet-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, deleted by ``sweep``."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again, for tables that are read several times.

    The files stay until ``sweep``, as results that are read later may need them.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete the stored tables of this application; call it once results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
