"""Shared-folder and table helpers used by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans.scratch import checkpointed, delete, drop, release, workspace
from paperloom.plans.scratch import fresh as fresh_dir

__all__ = ["checkpointed", "delete", "drop", "fresh_dir", "join_small", "read_blobs", "release", "saved", "workspace", "write_blobs"]


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as zstd Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_blobs(df: DataFrame, column: str, path: str, footer: str) -> None:
    """Writes each row's binary ``column`` as one file that ends with ``footer``.

    Spark's text writer is used because it commits task output atomically in any store Spark
    can write (a retried or speculative task never leaves half a file).  A cast from binary to
    string passes bytes through unchanged, and the writer's line separator, written after the
    single row of each file, is the format's own footer, so the files hold nothing else.
    """
    (
        df.selectExpr(f"cast(`{column}` as string) as value")
        .write.option("lineSep", footer)
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``write_blobs`` as rows (path, length, content)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select("path", "length", "content")
    )


#: Most rows that ``join_small`` broadcasts; rows of the tables given to it are short (a key and
#: a few numbers), so this bounds the broadcast to some tens of MB.
BROADCAST_ROWS = 200_000


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """A join with a table that is usually small but may not be.

    ``right`` is written to the shared folder and counted.  Up to ``most`` rows (fewer for longer ones) it is
    broadcast; beyond, Spark shuffles both sides and adaptive execution splits skewed keys.
    """
    right = checkpointed(right)
    if right.count() <= most:
        right = right.hint("broadcast")
    return left.join(right, on, how)
