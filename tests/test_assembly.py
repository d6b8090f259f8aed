"""Uploads share the calls that keep their state, and are told apart in them."""

import json
import os

from paperloom.streaming import assembly, intake


def landed(folder, name, pages):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(dict(zip(("upload_id", "document_number", "text", "expected", "at"), p, strict=True))) + "\n" for p in pages)


def told(spark, root, **how):
    """The outcomes that a run over all that landed adds, and the query."""
    stream = assembly.together(intake.arrivals(spark, f"file://{root}/in", max_files=1), **how)
    seen = []

    def note(rows, _):
        seen.extend((r.upload_id, r.document_number, r.text, r.outcome) for r in rows.collect())

    query = stream.writeStream.foreachBatch(note).option("checkpointLocation", f"file://{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(seen, key=str), query


def at(minute):
    return f"2024-05-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


def test_uploads_share_calls(spark, tmp_path):
    """A call of Python and a row of state aren't an upload's own: 3,000 uploads have as many as there are buckets."""
    landed(f"{tmp_path}/in", "1", [(f"u{i}", 1, f"text {i}", 2, at(0)) for i in range(3000)])
    seen, query = told(spark, tmp_path)
    assert sorted(s[0] for s in seen) == sorted(f"u{i}" for i in range(3000)) and {s[1:] for s in seen} == {(None, None, "waiting")}
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 1024
    landed(f"{tmp_path}/in", "2", [(f"u{i}", 2, f"more {i}", 2, at(1)) for i in range(0, 3000, 3)])
    seen, _ = told(spark, tmp_path)
    assert seen == sorted([(f"u{i}", n, f"{w} {i}", "whole") for i in range(0, 3000, 3) for n, w in ((1, "text"), (2, "more"))], key=str)


def test_time_of_an_upload_is_its_own(spark, tmp_path):
    """In one bucket: uploads get pages, run out of time, come late and are forgotten, whoever else gets pages."""
    landed(f"{tmp_path}/in", "1", [("a", 1, "A1", None, at(0)), ("b", 2, "B2", 3, at(0)), ("w", 1, "W1", 1, at(0))])
    landed(f"{tmp_path}/in", "2", [("x", 1, "X1", 1, at(90)), ("b", 1, "B1", 3, at(90)), ("b", 1, "again", 3, at(90))])
    for i in (1, 2):
        os.utime(f"{tmp_path}/in/{i}.json", (i * 1000, i * 1000))
    seen, _ = told(spark, tmp_path, idle_ms=60_000, keep_ms=3_600_000, buckets=1)
    assert seen == sorted([("a", None, None, "waiting"), ("b", None, None, "waiting"), ("b", None, None, "waiting"), ("w", 1, "W1", "whole"), ("x", 1, "X1", "whole"), ("a", 1, "A1", "idle")], key=str)
    landed(f"{tmp_path}/in", "3", [("a", 2, "late", None, at(91)), ("y", 1, "Y1", None, at(94))])  # b is idle at 93, told after this file
    seen, _ = told(spark, tmp_path, idle_ms=60_000, keep_ms=3_600_000, buckets=1)
    assert seen == sorted([("a", 2, "late", "late"), ("y", None, None, "waiting"), ("b", 1, "B1", "idle"), ("b", 2, "B2", "idle")], key=str)
    landed(f"{tmp_path}/in", "4", [("z", 1, "Z1", 1, at(400))])  # y is idle in the batch after; a, b, w and x are forgotten
    seen, _ = told(spark, tmp_path, idle_ms=60_000, keep_ms=3_600_000, buckets=1)
    assert seen == sorted([("z", 1, "Z1", "whole"), ("y", 1, "Y1", "idle")], key=str)
    landed(f"{tmp_path}/in", "5", [("a", 7, "anew", 1, at(401)), ("z", 2, "late", 1, at(401))])
    seen, _ = told(spark, tmp_path, idle_ms=60_000, keep_ms=3_600_000, buckets=1)
    assert seen == sorted([("a", 7, "anew", "whole"), ("z", 2, "late", "late")], key=str)


def test_pages_without_a_number_are_kept(spark, tmp_path):
    landed(f"{tmp_path}/in", "1", [("a", None, "A", 3, at(0)), ("a", None, None, 3, at(0)), ("b", 1, None, 2, at(0))])
    told(spark, tmp_path, buckets=1)
    landed(f"{tmp_path}/in", "2", [("a", 4, "A4", 3, at(1)), ("b", 2, "B2", 2, at(1))])
    seen, _ = told(spark, tmp_path, buckets=1)
    assert seen == sorted([("a", 4, "A4", "whole"), ("a", None, "A", "whole"), ("a", None, None, "whole"), ("b", 1, None, "whole"), ("b", 2, "B2", "whole")], key=str)
