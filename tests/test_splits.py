"""A failing batch is split by writing each part once."""

import os
import threading
import time

from pyspark.sql import functions as F

from paperloom.plans import scratch
from paperloom.streaming import intake


def test_what_is_tried_next_reads_its_own_uploads(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        seen.add(1)
        return text

    noted = noted.asNondeterministic()
    rows = spark.range(400).select(F.col("id").cast("string").alias("upload_id"), F.lit(1).alias("document_number"), F.col("id").cast("string").alias("text"))
    rows = rows.withColumn("text", noted("text"))

    def work(pages):
        return pages.withColumn("text", F.when(F.col("upload_id") == "77", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("text")))

    with scratch.workspace(spark):
        failed = list(intake._worked(rows, work, f"file://{tmp_path}/out", F.xxhash64("upload_id")))
    assert failed == ["77"]
    done = {r.upload_id for r in spark.read.schema(rows.schema).parquet(f"file://{tmp_path}/out").collect()}
    assert done == {str(i) for i in range(400)} - {"77"}
    assert seen.value <= 4 * 400  # the first try, the look for two uploads and the first split; not once a level


def test_parts_of_a_split_are_tried_at_once(spark, tmp_path):
    lock, now, most = threading.Lock(), [0], [0]
    rows = spark.range(60).select(F.col("id").cast("string").alias("upload_id"), F.lit(1).alias("document_number"), F.lit("x").alias("text"))

    def work(pages):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.5)
        with lock:
            now[0] -= 1
        return pages.withColumn("text", F.when(F.col("upload_id").isin("7", "13"), F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("text")))

    with scratch.workspace(spark) as made:
        failed = list(intake._worked(rows, work, f"file://{tmp_path}/out", F.xxhash64("upload_id")))
    assert sorted(failed) == ["13", "7"] and 2 <= most[0] <= 16
    assert not [p for p in made.made if os.path.exists(p.removeprefix("file://"))]
    done = [r.upload_id for r in spark.read.schema(rows.schema).parquet(f"file://{tmp_path}/out").collect()]
    assert sorted(done) == sorted({str(i) for i in range(60)} - {"7", "13"})
