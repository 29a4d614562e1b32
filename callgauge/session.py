"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "callgauge", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume: UTC, Arrow, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    On a cluster a missing setting is an error: files in a machine-local folder would be lost to the other
    executors. Only a session without executors of its own (a ``local`` master, as in tests) may leave it
    unset; it then keeps its stage tables in one folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {context.master} share")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="callgauge-"))
        return context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Paths handed out inside each open ``stage_tables``, the innermost last.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never used before."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Stage tables written inside are removed at the end; what is to be kept must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def shuffle_width(spark: SparkSession) -> int:
    """Number of ranges worth making: one per shuffle partition."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage table to the shared folder and read it back: later passes neither repeat
    its work nor depend on the executors that did it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stage table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
