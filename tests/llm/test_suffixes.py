"""The radix sort of suffixes and the removal of repeated byte strings against plain code."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import suffixes


def plain(rows, threshold):
    """(removed spans, kept bytes) of each (id, text): every string's first place is by id, text's hash, place."""
    seen, out = set(), {}
    order = sorted({(i is None, i or 0, hashlib.sha256((t or "").encode()).digest(), (t or "").encode()) for i, t in rows})
    for none, i, _, b in order:
        covered = bytearray(len(b))
        fresh = set()
        for p in range(len(b) - threshold + 1):
            h = b[p : p + threshold]
            if h in seen or h in fresh:
                covered[p : p + threshold] = b"\1" * threshold
            fresh.add(h)
        seen |= fresh
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(covered), np.uint8), [0]]).astype(int)))
        out[None if none else i, b] = [(int(x), int(y)) for x, y in edges.reshape(-1, 2)], bytes(x for x, y in zip(b, covered) if not y)
    return out


def check(spark, rows, threshold=24, gram=8, heavy=5, parts=3):
    df = spark.createDataFrame([(i, t, "mine", 5) for i, t in rows], "doc_id long, text string, kept string, n_bytes int").repartition(parts)
    got = suffixes.remove_repeats(df, threshold=threshold, gram=gram, heavy=heavy).collect()
    want = plain(rows, threshold)
    assert len(got) == len(rows)
    for r in got:
        b = (r.text or "").encode()
        spans, kept = want[r.doc_id, b]
        assert [(s.start, s.end) for s in r.spans or []] == spans, (r.doc_id, spans)
        assert (b if r.kept is None else bytes(r.kept)) == kept
        assert (r.n_bytes, bytes(r.sha256)) == (len(b), hashlib.sha256(b).digest())
    return got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=8), st.integers(1, 30))
def test_radix_sort(texts, threshold):
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
    place = np.array([p for a, z in zip(first, first[1:]) for p in range(a, z - threshold + 1)], dtype=np.int64)
    at = np.random.default_rng(len(data)).permutation(len(place))
    got = suffixes.repeated(data, place, np.zeros(len(place), np.int64), at, threshold)
    least = {}
    for p, x in zip(place.tolist(), at.tolist()):
        b = bytes(data[p : p + threshold])
        least[b] = min(least.get(b, x), x)
    assert got.tolist() == [x != least[bytes(data[p : p + threshold])] for p, x in zip(place.tolist(), at.tolist())]


def test_equal_suffixes_share_their_digit():
    rnd = random.Random(1)
    passage = bytes(rnd.choice(b"abcd ") for _ in range(400))
    a, b = bytes(rnd.choice(b"abcd ") for _ in range(157)) + passage, b"aaaa" * 60 + passage + b"zz"
    data, first = np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)])
    start, n, anchor, owner, name = suffixes.runs(data, first)
    of = {}
    for s, k, x, o, h in zip(start.tolist(), n.tolist(), anchor.tolist(), owner.tolist(), name.tolist()):
        assert 1 <= k <= 69 and s + k - 1 <= x <= s + 68
        for p in range(s, s + k):
            assert p + 100 <= first[o + 1]
            of.setdefault(bytes(data[p : p + 100]), set()).add((h, x - p))
    assert sum(n) == len(a) + len(b) - 198
    assert all(len(v) == 1 for v in of.values())


def test_texts(spark):
    rnd = random.Random(7)
    some = lambda n: "".join(rnd.choice(["alpha ", "beta ", "é", "日本", "\n", "x"]) for _ in range(n))
    passage = some(40)
    rows = [(i, some(10) + (passage if i % 2 else "") + some(15)) for i in range(30)]
    rows += [(40, "a" * 500), (41, "ab" * 300 + "a" * 90), (42, None), (43, ""), (44, "short"), (None, passage), (None, "a" * 30), rows[3], rows[3], (50, rows[5][1]), (3, "other text of the same id, of some length"), (51, some(4000))]
    check(spark, rows)
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_values_of_many_runs(spark):
    """One line in all texts, shorter than the threshold or longer, with other bytes around: dealt out by longer digits."""
    rnd = random.Random(11)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    short, long = letters(20), letters(70)
    rows = [(i, letters(rnd.randrange(40)) + short + letters(30) + long + letters(rnd.randrange(2)) + letters(25)) for i in range(150)]
    check(spark, rows, heavy=4)


def test_production_depth(spark, monkeypatch):
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = some(60)
    rows = [(i, f"{some(40)} {passage if i % 3 else some(20)[:99]} {some(30)}") for i in range(60)] + [(90, some(9000))]
    rows.append((91, rows[-1][1][5000:30000]))
    check(spark, rows, threshold=100, gram=32, heavy=16)


@pytest.mark.parametrize("threshold, gram", [(24, 12), (200, 32), (8, 16)])
def test_bad_options(spark, threshold, gram):
    with pytest.raises(ValueError):
        suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), threshold=threshold, gram=gram)


def test_long_texts_come_in_parts():
    import pyarrow as pa
    import zstandard as zstd

    text = np.random.default_rng(1).integers(97, 101, suffixes.PART + 5000).astype(np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([zstd.ZstdCompressor().compress(text)], pa.binary())], ["rank", "packed"])
    parts = list(suffixes._parts(iter([batch]), 100))
    assert [p[3] for p in parts] == [0, suffixes.PART]
    assert [len(p[1]) for p in parts] == [suffixes.PART + 99, 5000]
    assert sum(suffixes.runs(p[1], p[2])[1].sum() for p in parts) == len(text) - 99
