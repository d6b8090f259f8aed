"""Uploads whose pages come in several files: pages wait in keyed state until their upload is whole.

An upload is whole when it has as many different pages as it says, or, where it doesn't say, when no page
came for ``idle`` of event time.  Its pages are then handed on together, once.  What comes afterwards is
late: it is handed on as such and changes nothing; the memory of a whole upload is dropped after ``keep``.

State is kept by buckets of uploads: a call of Python for each upload costs some milliseconds whatever it
does, so a bucket's uploads share one.  The number of buckets is fixed by a stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "upload_id string, document_number int, text string, broken boolean, outcome string"
#: By upload: its number of waiting pages, of pages it says (or null), whether it was handed on, when its time is over; then all pages in that order.
_STATE = "uploads array<string>, waiting array<int>, expected array<int>, closed array<boolean>, due array<bigint>, numbers array<int>, texts array<string>, broken array<boolean>"
BUCKETS = 1024


class _Upload:
    """What is kept of an upload; ``pages`` are (number, text, broken)."""

    __slots__ = ("pages", "numbers", "expected", "closed", "due")

    def __init__(self, pages: list[tuple], expected: int | None, closed: bool, due: int):
        self.pages, self.expected, self.closed, self.due = pages, expected, closed, due
        self.numbers = {p[0] for p in pages if p[0] is not None}

    def close(self) -> list[tuple]:
        """Its pages, which are forgotten."""
        pages, self.pages, self.numbers, self.expected, self.closed = self.pages, [], set(), None, True
        return pages


def _load(kept: tuple) -> dict[str | None, _Upload]:
    uploads, waiting, expected, closed, due, *pages = kept
    rows = zip(*pages, strict=True)
    return {u: _Upload([next(rows) for _ in range(n)], of, shut, at) for u, n, of, shut, at in zip(uploads, waiting, expected, closed, due, strict=True)}


def _dump(held: dict[str | None, _Upload]) -> tuple:
    pages = [p for u in held.values() for p in u.pages]
    by_upload = [(name, len(u.pages), u.expected, u.closed, u.due) for name, u in held.items()]
    return (*([r[i] for r in by_upload] for i in range(5)), *([p[i] for p in pages] for i in range(3)))


def together(stream: DataFrame, delay: str = "1 minute", idle_ms: int = 600_000, keep_ms: int = 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """Pages (upload_id, document_number, text, broken, expected, at) with outcome, by upload.

    outcome is ``waiting`` (a row without a page: the upload isn't whole yet), ``whole``, ``idle`` or
    ``late``.  ``expected`` is the upload's number of pages, or null; ``at`` is event time, late by
    ``delay`` at most.  Of a page that comes twice before its upload is whole the first counts.
    """

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _load(state.get) if state.exists else {}
        now, came, out = state.getCurrentWatermarkMs(), {}, []

        def tell(name: str | None, pages: list[tuple], outcome: str) -> None:
            out.extend((name, *p, outcome) for p in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)))

        for pdf in () if state.hasTimedOut else batches:
            columns = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("upload_id", "document_number", "text", "broken", "expected", "ms"))
            for name, n, text, bad, of, at in zip(*columns, strict=True):
                upload = held.get(name)
                if upload is None:
                    upload = held[name] = _Upload([], None, False, 0)
                seen = came.setdefault(name, [now, []])
                seen[0] = max(seen[0], now if at is None else int(at))
                n, of = None if n is None else int(n), None if of is None else int(of)
                if upload.closed:
                    seen[1].append((n, text, bool(bad)))
                elif n is None or n not in upload.numbers:
                    upload.pages.append((n, text, bool(bad)))
                    if n is not None:
                        upload.numbers.add(n)
                    upload.expected = of if upload.expected is None else upload.expected
                    if upload.expected is not None and len(upload.pages) >= upload.expected:
                        tell(name, upload.close(), "whole")
        for name, (last, late) in came.items():
            upload = held[name]
            tell(name, late, "late")
            if not upload.closed:
                out.append((name, None, None, False, "waiting"))
            upload.due = max(last + (keep_ms if upload.closed else idle_ms), now + 1)
        for name in [name for name, upload in held.items() if upload.due < now and name not in came]:
            if held[name].closed:
                del held[name]
            else:
                tell(name, held[name].close(), "idle")
                held[name].due = now + keep_ms
        if out:
            names, numbers, texts, broken, outcomes = zip(*out, strict=True)
            yield pd.DataFrame({"upload_id": names, "document_number": pd.array(numbers, dtype="Int32"), "text": texts, "broken": broken, "outcome": outcomes})
        if held:
            state.update(_dump(held))
            state.setTimeoutTimestamp(max(min(upload.due for upload in held.values()), now + 1))
        else:
            state.remove()

    rows = stream.select("upload_id", "document_number", "text", "broken", F.col("expected").cast("int").alias("expected"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", delay).withColumns({"ms": F.unix_millis("at"), "bucket": F.pmod(F.xxhash64("upload_id"), F.lit(buckets))})
    return rows.groupBy("bucket").applyInPandasWithState(collect, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
