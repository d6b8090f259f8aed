"""Intermediate files: made in one folder, deleted by their path."""

import os

import pytest

from paperloom.plans import scratch
from paperloom.queries import result_records


def files(spark):
    at = scratch.root(spark).removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(at) for f in names}


def test_a_workspace_leaves_nothing(spark):
    before = files(spark)
    with scratch.workspace(spark):
        rows = scratch.checkpointed(spark.range(100).selectExpr("id", "id % 7 as k").groupBy("k").count())
        path = scratch.fresh(spark, "rows")
        rows.write.parquet(path)
        assert spark.read.parquet(path).count() == rows.count() == 7
        assert len(files(spark)) > len(before)
    assert files(spark) == before


def test_a_workspace_leaves_nothing_of_failed_work(spark):
    before = files(spark)
    with pytest.raises(ValueError), scratch.workspace(spark):
        scratch.checkpointed(spark.range(10))
        raise ValueError
    assert files(spark) == before


def test_nested_workspaces_keep_what_is_handed_out(spark):
    before = files(spark)
    with scratch.workspace(spark):
        with scratch.workspace(spark) as inner:
            scratch.checkpointed(spark.range(10))
            rows = inner.keep(scratch.checkpointed(spark.range(20)))
        assert rows.count() == 20 and files(spark) > before
    assert files(spark) == before


def test_drop(spark):
    before = files(spark)
    a, b = scratch.checkpointed(spark.range(10)), scratch.checkpointed(spark.range(5))
    scratch.drop(a)
    assert b.count() == 5
    scratch.drop(b)
    assert files(spark) == before


def test_result_records_leave_nothing(spark):
    before = files(spark)
    with scratch.workspace(spark):
        rows = result_records(spark, "/root/testdata/sf0.001").collect()
    assert rows and files(spark) == before
