"""Folders for intermediate tables, which the driver and all executors see.

Within ``workspace`` every folder and checkpoint that is made is deleted at its end; outside, it stays
until its maker deletes it or the cluster clears ``spark.checkpoint.dir``, as a lazy result may still
read it.  Write or collect a query's result inside a workspace to leave nothing behind.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_made: ContextVar[list[str] | None] = ContextVar("paperloom_made", default=None)


def root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path under ``root``; no two calls return the same one."""
    return _noted(f"{root(spark)}/{label}-{uuid.uuid4().hex}")


def _noted(path: str) -> str:
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


class Workspace:
    """What was made within a ``with workspace(spark)`` block."""

    def __init__(self, outer: list[str] | None):
        self.made: list[str] = []
        self._outer = outer

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, which ``checkpointed`` returned, outlives the block; a block around it still deletes it."""
        path = _checkpoint(df)
        self.made.remove(path)
        if self._outer is not None:
            self._outer.append(path)
        return df


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Workspace]:
    """Deletes what ``fresh`` and ``checkpointed`` make inside, also where the work fails."""
    work = Workspace(_made.get())
    token = _made.set(work.made)
    try:
        yield work
    finally:
        _made.reset(token)
        for path in work.made:
            delete(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to ``root``, lineage cut; survives lost executors."""
    root(df.sparkSession)
    out = df.checkpoint(eager=True)
    _noted(_checkpoint(out))
    return out


def _checkpoint(df: DataFrame) -> str:
    """The folder of a table that ``checkpointed`` returned."""
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``checkpointed`` returned and nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, _checkpoint(df))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no table is read from any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more (``drop`` deletes checkpoints).

    Its cleaner acts when the driver collects garbage, every half an hour at least; a job of many
    rounds needs its disk sooner.
    """
    gc.collect()
    spark._jvm.System.gc()
