"""Keyed tables, and streams whose uploads come in pieces or fail."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from paperloom.plans import scratch
from paperloom.plans.keyed import KeyedTable
from paperloom.streaming import assembly, intake

ROW = "upload_id string, status string, at long"


def rows(df):
    return {r.upload_id: (r.status, r.at) for r in df.collect()}


def test_batches_are_merged_by_key(spark):
    t = KeyedTable(spark, scratch.fresh(spark, "keyed"), ROW, buckets=4)
    assert t.read().count() == 0 and t.get(spark.createDataFrame([("u1",)], "upload_id string")).count() == 0
    rnd, want = random.Random(1), {}
    for _ in range(4):
        new = [(f"u{rnd.randrange(30)}", rnd.choice("abc"), rnd.randrange(6)) for _ in range(25)]
        t.upsert(spark.createDataFrame(new, ROW))
        best = {}
        for k, s, at in new:
            best[k] = max(best.get(k, (-1, "")), (at, s))
        for k, (at, _) in best.items():
            if k not in want or at >= want[k]:
                want[k] = at
        assert {k: at for k, (_, at) in rows(t.read()).items()} == want
    assert t.versions() == [1, 2, 3, 4]
    t.upsert(spark.createDataFrame([], ROW))
    assert t.versions() == [1, 2, 3, 4]


def test_a_repeated_batch_changes_nothing_and_the_new_of_equals_counts(spark):
    t = KeyedTable(spark, scratch.fresh(spark, "keyed"), ROW, buckets=2)
    for said in ("a", "a", "b"):
        t.upsert(spark.createDataFrame([("x", said, 3), ("y", "old", 1)], ROW))
    t.upsert(spark.createDataFrame([("x", "earlier", 2)], ROW))
    assert rows(t.read()) == {"x": ("b", 3), "y": ("old", 1)}


def test_a_lookup_reads_its_buckets_alone(spark):
    path = scratch.fresh(spark, "keyed")
    t = KeyedTable(spark, path, ROW, buckets=16)
    t.upsert(spark.createDataFrame([(f"u{i}", "s", i) for i in range(200)], ROW))
    got = t.get(spark.createDataFrame([("u7",), ("none",), ("u7",)], "upload_id string"))
    assert rows(got) == {"u7": ("s", 7)} and len(got.inputFiles()) <= 2 < len(t.read().inputFiles())


def test_two_writers(spark, monkeypatch):
    """A version that another writer published first is built upon, not overwritten."""
    path = scratch.fresh(spark, "keyed")
    a, b = KeyedTable(spark, path, ROW, buckets=1), KeyedTable(spark, path, ROW, buckets=1)
    publish, beaten = a._publish, []

    def slow(version, folders):
        if not beaten:
            beaten.append(version)
            b.upsert(spark.createDataFrame([("b", "from b", 1)], ROW))
        return publish(version, folders)

    monkeypatch.setattr(a, "_publish", slow)
    a.upsert(spark.createDataFrame([("a", "from a", 1)], ROW))
    assert rows(b.read()) == {"a": ("from a", 1), "b": ("from b", 1)} and a.versions() == [1, 2]


def test_vacuum_keeps_what_is_named(spark):
    path = scratch.fresh(spark, "keyed")
    t = KeyedTable(spark, path, ROW, buckets=8)
    t.upsert(spark.createDataFrame([(f"u{i}", "s", 0) for i in range(50)], ROW))
    for i in range(5):
        t.upsert(spark.createDataFrame([("u1", f"s{i}", i + 1)], ROW))
    before = rows(t.read())
    t.vacuum()
    assert rows(t.read()) == before and t.versions() == [6]
    folders = [d for d, _, names in os.walk(f"{path.removeprefix('file://')}/data") if any(n.endswith(".parquet") for n in names)]
    assert len(folders) == 8  # one folder a bucket


def landed(folder, name, pages):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines((p if isinstance(p, str) else json.dumps(dict(zip(("upload_id", "document_number", "text", "expected", "at"), p, strict=True)))) + "\n" for p in pages)


def ran(spark, root, work, pieces=True):
    stream = intake.arrivals(spark, f"file://{root}/in", max_files=1)
    stream = assembly.together(stream, idle_ms=60_000) if pieces else stream
    intake.run_once(stream, work, f"file://{root}/out", f"file://{root}/status", f"file://{root}/checkpoint").awaitTermination()
    return {r.upload_id: (r.status, r.pages) for r in intake.statuses(spark, f"file://{root}/status").collect()}


def numbers(pages):
    return pages.groupBy("upload_id").agg(F.array_sort(F.collect_list("document_number")).alias("n"), F.concat_ws("", F.array_sort(F.collect_list("text"))).alias("t"))


def outcome(spark, root):
    return {r.upload_id: (r.n, r.t) for r in spark.read.schema("upload_id string, n array<int>, t string").parquet(f"file://{root}/out").collect()}


def test_pages_wait_for_their_upload(spark, tmp_path):
    at = lambda m: f"2024-05-01T{m // 60:02d}:{m % 60:02d}:00Z"
    landed(f"{tmp_path}/in", "1", [("a", 2, "A2", 2, at(0)), ("b", 1, "B1", None, at(0)), ("c", 1, "C1", 3, at(0)), ("c", 1, "again", 3, at(0))])
    assert ran(spark, tmp_path, numbers) == {k: ("processing", 0) for k in "abc"}
    landed(f"{tmp_path}/in", "2", [("a", 1, "A1", 2, at(1)), ("b", 2, "B2", None, at(1)), ("d", 1, None, 1, at(1))])
    said = ran(spark, tmp_path, numbers)
    assert said["a"] == ("completed", 2) and said["b"] == said["c"] == ("processing", 0) and said["d"] == ("failed", 1)
    landed(f"{tmp_path}/in", "3", [("a", 3, "late", 2, at(30)), ("e", 1, "E1", 1, at(90))])  # b's and c's time is over
    said = ran(spark, tmp_path, numbers)
    assert said == {"a": ("completed", 2), "b": ("completed", 2), "c": ("completed", 1), "d": ("failed", 1), "e": ("completed", 1)}
    assert outcome(spark, tmp_path) == {"a": ([1, 2], "A1A2"), "b": ([1, 2], "B1B2"), "c": ([1], "C1"), "e": ([1], "E1")}
    assert rows(KeyedTable(spark, f"file://{tmp_path}/status", intake.STATUS).get(spark.createDataFrame([("b",)], "upload_id string"))).keys() == {"b"}


def test_a_failing_upload_doesn_t_end_its_batch(spark, tmp_path):
    landed(f"{tmp_path}/in", "1", [(f"u{i}", n, f"{i}", 2, "2024-05-01T00:00:00Z") for i in range(40) for n in (1, 2)])

    def work(pages):
        return numbers(pages.withColumn("text", F.when(F.col("upload_id").isin("u3", "u17"), F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("text"))))

    said = ran(spark, tmp_path, work, pieces=False)
    assert {k for k, v in said.items() if v[0] == "failed"} == {"u3", "u17"} and len(said) == 40
    assert outcome(spark, tmp_path).keys() == said.keys() - {"u3", "u17"}


def test_a_fault_of_all_ends_the_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(intake, "MOST_FAILED", 2)
    landed(f"{tmp_path}/in", "1", [(f"u{i}", 1, "x", 1, "2024-05-01T00:00:00Z") for i in range(6)])

    def work(pages):
        raise OSError("no room")

    with pytest.raises(Exception, match="over 2 uploads"):
        ran(spark, tmp_path, work, pieces=False)
    assert {s for s, _ in (v for v in {r.upload_id: (r.status, r.pages) for r in intake.statuses(spark, f"file://{tmp_path}/status").collect()}.values())} == {"processing"}
