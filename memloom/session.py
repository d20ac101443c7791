"""Session helpers: table reading, shared checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its optimised plan is estimated below this many bytes.
BROADCAST_LIMIT = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, on one machine only (tests), one of our own where that is unset.

    A cluster without the setting is refused: steps written to each machine's own disk would be read back incomplete.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"memloom-checkpoints-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """``DataFrame.checkpoint`` into the shared folder (never localCheckpoint)."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: columnar, prunable, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # with the driver at the latest
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


_scope: ContextVar[list | None] = ContextVar("steps", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Delete, at the end, the steps written inside: for services and streams, whose driver doesn't end. What is read from
    them must have been collected or written elsewhere by then. A scope inside another leaves its steps to the outer one."""
    if _scope.get() is not None:
        yield
        return
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; huge when unknown."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the estimated size is within ``limit``; otherwise the join shuffles."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster runs tasks, before work that is heavy per row.

    Inputs of several files already have them and stay where they are; a single small file would keep one core busy.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():  # counting its partitions would run it; a shuffle has spread it already
        return df
    return df.repartition(want) if plan.execute().getNumPartitions() < want else df
