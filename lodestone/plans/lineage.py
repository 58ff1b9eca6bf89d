"""Where rows lie: written tables that cut lineage, and small inputs dealt to all cores."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only a local session may do without it: one machine's temporary folder is no use to executors elsewhere.
    """
    given = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="spark-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def own_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new place, not made yet, in a new folder of the shared one; the application's end deletes it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{path.toString()}/rows"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; the application's end deletes it."""
    path = own_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


T = TypeVar("T")

#: A written table is sent to the driver for a join if its files are no larger; as rows it may take ten times that and more.
SENT = "256KB"


def joined_in_tasks(make: Callable[..., T]) -> Callable[..., T]:
    """``make(table, ...)``, which writes all that it computes, with only very small tables sent through the driver for its joins.

    Dozens of joins, each of which may send a table below the session's threshold, add up; others are shuffled.
    """

    @functools.wraps(make)
    def run(first, *more, **named):
        conf, key = (getattr(first, "nodes", first)).sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
        was = conf.get(key, None)
        conf.set(key, SENT)
        try:
            return make(first, *more, **named)
        finally:
            conf.unset(key) if was is None else conf.set(key, was)

    return run


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its files are cut into fewer parts than that; any larger input stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
