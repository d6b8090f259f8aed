"""File-arrival streams: landing folder to result records, with a status per upload.

Pages of an upload that come in one file are worked on in that file's batch; where they come in several,
``assembly.together`` keeps them until the upload is whole.  Statuses are kept in a keyed table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.plans.keyed import KeyedTable
from paperloom.plans.results import result_records
from paperloom.plans.scratch import delete, fresh, workspace

PAGES = "upload_id string, document_number int, text string, expected int, at timestamp"
STATUS = "upload_id string, status string, pages long, at long"
#: What a batch uses of a stream's columns.
USED = ("upload_id", "document_number", "text", "broken", "outcome")
#: Ways in which a set of uploads that fails is split, and the most uploads of a batch that may fail by their own.
SPLIT = 4
MOST_FAILED = 100
#: Most parts of a split batch that are worked on at the same time.
AT_ONCE = 16


def arrivals(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of files of JSON lines (upload_id, document_number, text, and at will expected and at) as they land.

    A line that is no page (no JSON, a wrong type, a missing number or text) is marked broken; one
    without an upload's id belongs to an upload named like its file.  ``expected`` is the upload's number of
    pages; ``at`` is when the page was made, by default when its file was written.
    """
    rows = spark.readStream.schema(PAGES + ", line string").option("columnNameOfCorruptRecord", "line").option("maxFilesPerTrigger", max_files).json(folder)
    broken = F.col("line").isNotNull() | F.col("document_number").isNull() | F.col("text").isNull()
    return rows.select(
        F.coalesce("upload_id", F.regexp_replace("_metadata.file_name", r"\.[^.]+$", "")).alias("upload_id"), "document_number", "text", broken.alias("broken"),
        "expected", F.coalesce("at", "_metadata.file_modification_time").alias("at"),
    )


def status_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, STATUS)


def _worked(rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, part: Column) -> Iterator[str]:
    """Writes ``work(rows)`` and gives the uploads for which it fails: on a failure the uploads are split until those are alone.

    Each split is written once in folders, so that what is tried next reads its own uploads and not the whole batch.
    Up to ``AT_ONCE`` sets are tried at once, the smallest first.
    """
    spark = rows.sparkSession

    def tried(mine: DataFrame, name: str) -> bool:
        try:
            with workspace(spark):
                work(mine).write.mode("overwrite").parquet(f"{out}/part={name}")
            return True
        except Exception:
            delete(spark, f"{out}/part={name}")
            return False

    def split(mine: DataFrame, ways: int, at: int, path: str) -> list[tuple]:
        """The parts that hold uploads: rows, number of ways and place among them, the first upload, whether it is alone."""
        way = ((F.pmod(part, F.lit(ways * SPLIT)) - at) / ways).cast("int")
        mine.withColumn("__way", way).write.partitionBy("__way").parquet(path)
        whole, name = spark.read.schema(mine.select("*", way.alias("__way")).schema).parquet(path), F.struct("upload_id")
        ends = whole.groupBy("__way").agg(F.min(name)["upload_id"].alias("first"), F.max(name)["upload_id"].alias("last")).collect()  # SPLIT rows at most
        return [(whole.where(F.col("__way") == r["__way"]).drop("__way"), ways * SPLIT, at + r["__way"] * ways, r["first"], r["first"] == r["last"]) for r in ends]

    if tried(rows, "1-0"):
        return
    some = [r.upload_id for r in rows.select("upload_id").distinct().limit(2).collect()]
    if len(some) < 2:
        yield from some
        return
    failing, left, paths = [(rows, 1, 0)], [], []
    try:
        with ThreadPoolExecutor(AT_ONCE) as pool:

            def each(call: Callable, *over: tuple) -> list:
                """What ``call`` gives for each, in threads with this one's folders and job properties."""
                return [f.result() for f in [pool.submit(copy_context().run, inheritable_thread_target(spark)(call), *x) for x in over]]

            while failing or left:
                new = [fresh(spark, "split") for _ in failing]
                paths += new
                for parts in each(split, *[(*x[:3], path) for x, path in zip(failing, new, strict=True)]):
                    left += parts
                now, left = left[-AT_ONCE:], left[:-AT_ONCE]
                done = each(tried, *[(x[0], f"{x[1]}-{x[2]}") for x in now])
                failing = [x for x, fine in zip(now, done, strict=True) if not fine]
                yield from [x[3] for x in failing if x[4]]
                failing = [x for x in failing if not x[4]]
    finally:
        for path in paths:
            delete(spark, path)


def run_once(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, status: str, checkpoint: str) -> StreamingQuery:
    """Processes all that has landed: results by batch id, statuses in the table at ``status``.

    An upload is "processing" from when its first page comes; then "failed" if one of its pages is broken
    or ``work`` fails for it, else "completed" with its result.  A failure of ``work`` doesn't end the batch:
    the uploads are split until those that fail are alone.  More than ``MOST_FAILED`` of them are taken for a
    fault that isn't theirs, and end the stream.  A repeated batch replaces what it wrote and said.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        with workspace(spark):
            process(written(rows.select([c for c in USED if c in rows.columns])), batch_id)

    def written(rows: DataFrame) -> DataFrame:
        """``rows``, told once, in the caller's session: a batch's own one plans without adaptive execution."""
        path = fresh(spark, "batch")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def process(rows: DataFrame, batch_id: int) -> None:
        said = status_table(spark, status)
        pieces = "outcome" in rows.columns  # late pages change nothing, and waiting uploads have none yet
        ready = rows.where("outcome in ('whole', 'idle')") if pieces else rows
        uploads = written(ready.groupBy("upload_id").agg(F.count("*").alias("pages"), F.bool_or("broken").alias("broken")))

        def states(uploads: DataFrame, step: int, state: Column) -> DataFrame:
            return uploads.select("upload_id", state.alias("status"), "pages", F.lit(4 * batch_id + step).cast("long").alias("at"))

        begun = states(uploads, 1, F.lit("processing"))
        if pieces:
            begun = begun.unionByName(states(rows.where("outcome = 'waiting'").select("upload_id", F.lit(0).cast("long").alias("pages")), 0, F.lit("processing")))
        said.upsert(begun)
        good = ready.join(uploads.where("broken").select("upload_id"), "upload_id", "left_anti").select("upload_id", "document_number", "text")
        folder = f"{out}/batch={batch_id}"
        delete(spark, folder)
        failed = []
        for name in _worked(good, work, folder, F.xxhash64("upload_id")):
            failed.append(name)
            if len(failed) > MOST_FAILED:
                raise RuntimeError(f"work fails for over {MOST_FAILED} uploads of batch {batch_id}")
        said.upsert(states(uploads, 2, F.when(F.col("broken") | F.col("upload_id").isin(failed), "failed").otherwise("completed")))
        said.vacuum(2)

    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, status: str) -> DataFrame:
    """The latest status of each upload."""
    return status_table(spark, status).read().select("upload_id", "status", "pages")


def status_of(spark: SparkSession, status: str, wanted: DataFrame) -> DataFrame:
    """The latest status of the uploads in ``wanted`` (upload_id); only their buckets are read."""
    return status_table(spark, status).get(wanted).select("upload_id", "status", "pages")


def results_of(pages: DataFrame) -> DataFrame:
    """What a batch does with its pages: the whole path of a batch job."""
    return result_records(pages)
