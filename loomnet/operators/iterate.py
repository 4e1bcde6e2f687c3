"""Fixed points of DataFrames, with lineage cut in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of our own, and that on a single machine only."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="loomnet-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/loomnet/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in spark.checkpoint.dir; a folder of our own only where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)


def settled(spark: SparkSession, start: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool], most: int = 200) -> DataFrame:
    """start after as many steps as it takes."""
    d = cut(start)
    for _ in range(most):
        if done(d):
            return d
        d = cut(step(d))
    raise RuntimeError("no fixed point")
