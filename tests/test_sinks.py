"""Sinks, lookups, settings and the recogniser boundary."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import older
from paperloom.plans import scratch, sinks
from paperloom.sources import adapters, landing, settings


def test_results_come_back_one_by_one(spark):
    df = spark.createDataFrame([(f"u{i}", i, [i, i + 1]) for i in range(50)], "upload_id string, total int, parts array<int>")
    path = scratch.fresh(spark, "t")
    sinks.write_results(df, path, 8)
    sinks.write_results(df.where("total < 40"), path, 8)
    assert [tuple(r) for r in sinks.read_result(spark, path, "u7", df.schema, 8).select(*df.columns).collect()] == [("u7", 7, [7, 8])]
    assert sinks.read_result(spark, path, "u45", df.schema, 8).count() == 0
    plan = sinks.read_result(spark, path, "u7", df.schema, 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_raw_uploads_texts_and_tokens_are_kept(spark):
    up = spark.createDataFrame([("a", bytearray(b"%PDF"), True), ("b", bytearray(b"no"), False)], "upload_id string, content binary, accepted boolean")
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two")], "upload_id string, document_number int, text string")
    paths = [scratch.fresh(spark, "t") for _ in range(3)]
    sinks.keep_uploads(up, paths[0], 4)
    sinks.keep_page_texts(pages, paths[1], 4)
    sinks.keep_tokens(pages.withColumn("x0", F.lit(1.5)), paths[2], 4)
    assert [(r.name, bytes(r.content)) for r in spark.read.parquet(paths[0]).collect()] == [("a.pdf", b"%PDF")]
    assert {(r.name, r.text) for r in spark.read.json(paths[1]).collect()} == {("extracted_text_page_1.txt", "one"), ("extracted_text_page_2.txt", "two")}
    assert spark.read.json(paths[2]).where("x0 = 1.5").count() == 2
    scratch.delete(spark, paths[2])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.json(paths[2])


def test_uploads_are_accepted_by_extension_and_size(spark, tmp_path):
    for name, size in (("a.pdf", 10), ("b.PDF", 10), ("c.txt", 10), ("d.e.pdf", 3000)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r.upload_id: r.accepted for r in landing.uploads(spark, str(tmp_path), most_bytes=1000).collect()}
    assert got == {"a": True, "b": True, "c": False, "d.e": False}


def test_pages_that_fail_are_reported(spark):
    class Reader:
        def tokens(self, content, page):
            if content == b"bad":
                raise ValueError("unreadable")
            return [("word", 0.9, 0.0, 0.0, 1.0, 1.0)]

    images = spark.createDataFrame([("a", 1, bytearray(b"x")), ("a", 2, bytearray(b"bad"))], "upload_id string, page int, content binary")
    got = adapters.recognise(images, Reader)
    assert [tuple(r) for r in adapters.failures(got).collect()] == [("a", 2, "ValueError: unreadable")]
    assert [r.text for r in adapters.tokens_of(got).collect()] == ["word"]


def test_engines_that_do_not_load_are_left_out():
    def broken(language):
        raise ImportError("no library")

    adapters.register("Works", lambda language: language)
    adapters.register("broken", broken)
    assert adapters.engines(["works", "broken", "unknown"], "ms") == ["ms"]
    with pytest.raises(ImportError):
        adapters.engines(["broken", "works"])


def test_settings_are_loaded_once_and_reloaded_safely():
    reads = []

    def read(template):
        reads.append(template)
        return {"config_version": f"{1 if len(reads) < 3 else 2}.{len(reads)}", "ocr": {"engine": "e"}}

    s = settings.Settings(read, "1.0")
    assert s.get() == s.get() and reads == [None]
    assert s.section("ocr") == {"engine": "e"} and s.section("none") == {} and settings.engine_name(s.get()) == "e"
    new = s.reload(actor="me")
    assert new["config_version"] == "1.2" and new["reload_metadata"]["previous_version"] == "1.1" and new["reload_metadata"]["actor"] == "me"
    with pytest.raises(ValueError, match="version"):
        s.reload()
    assert s.get()["config_version"] == "1.2" and settings.engine_name({}) == settings.DEFAULT_ENGINE


def test_default_fields_take_looser_shapes(spark):
    df = spark.createDataFrame([("رقم الهوية 900101141234\nالراتب الإجمالي : 1,200\nBulan 01-2024",)], "text string")
    r, other = older.payslip_record(df, fields=older.DEFAULT_PAYSLIP).first(), older.payslip_record(df).first()
    assert r.id_number == "900101141234" and r.month_year == "01-2024"
    assert other.id_number is None and other.month_year is None
