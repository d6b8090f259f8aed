"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

The suffix at each place of a text with ``THRESHOLD`` bytes left is ordered by those bytes only, by
passes over its digits from the most significant one on; a suffix that is alone in its group is done
with.  The groups left after the last pass are exactly the strings of ``THRESHOLD`` bytes that occur
more than once, and all but the first place of each are removed.

1. Texts with the same bytes are one text from here on, the first; others repeat it wholly.
2. The first pass deals suffixes out by a digit that neighbours share: the least (by hash) of the
   ``GRAM``-byte strings within the suffix's depth, the leftmost of equals, which equal suffixes have
   in the same place.  So a run of neighbouring suffixes moves as one short string.  Spark counts
   these digits' values; runs whose value occurs once need no further pass and are never moved.
3. Other runs are shuffled by their value, equal ones combined before.  Tasks take the values one
   after another and sort their suffixes by (place of the value, bytes 1-8, bytes 9-16, ...).
4. A value with over ``HEAVY`` different runs is dealt out by a longer digit first: what all suffixes
   of eight neighbouring places share, and where that is too common as well by the whole depth.  So no
   task holds an unbounded group.
5. First places come back to their texts as lists of runs; all other places are removed.

Counts, first places and combined runs are aggregated before their shuffles, so a passage in a third
of all documents costs a row per task.  Hashes only choose digits and group runs; suffixes are
compared by their bytes.  Texts are told apart by SHA-256.

Defined results: a null text is an empty one; null ids come after all others; texts with one id are
ordered by their hashes; repeated rows (same id and text) are one document with one result; texts
shorter than the threshold lose nothing; an empty table gives an empty one; columns of the input named
like an output are replaced.  Ranks are below 2**34 and positions below 2**29.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import checkpointed, join_small, saved
from paperloom.llm.substring import POSITION_BITS, _bucketed, _dropped, _listed, _partitions, _ranked
from paperloom.llm.words import mix, raw, slices

THRESHOLD = 100
GRAM = 32
HEAVY = 16_384
#: Neighbouring places whose common bytes are the longer digit.
FINER = 8
#: Suffixes of one text that are looked at together; longer texts are taken in parts.
PART = 1 << 20
#: Bytes of runs that a task sorts together, besides those of the last value.
SORT_BYTES = 2 << 20
PACKED_BYTES = 128 << 10
_RUN = 1 << 7  # a run of n places from p is p * _RUN + n; n is below GRAM-dependent 128
_DIGIT = 8
_WEIGHTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as a number; bytes beyond the end are zero."""
    padded = np.concatenate([data, np.zeros(_DIGIT, np.uint8)])
    return np.ndarray(len(data), dtype=kind, buffer=padded.data, strides=(1,))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of key[i:i + width] for each i."""
    level, p = key, 1
    while 2 * p <= width:
        level = np.minimum(level[:-p], level[p:])
        p *= 2
    m = len(key) - width + 1
    return np.minimum(level[:m], level[width - p : width - p + m])


def runs(data: np.ndarray, first: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(start, n, anchor, owner, name) of the runs of neighbouring suffixes with one anchor.

    data are the bytes of texts, first their offsets; anchor is the place of the least gram, name its
    hash, owner the text.
    """
    none = np.zeros(0, np.int64)
    size = np.diff(first)
    count = np.maximum(size - threshold + 1, 0)
    total = int(count.sum())
    if not total:
        return none, none, none, none, none.astype(np.uint64)
    w = _words(data)
    m = len(data) - gram + 1
    h = np.zeros(m, dtype=np.uint64)
    for i in range(0, gram, _DIGIT):
        x = w[i : i + m] * _WEIGHTS[0]
        x ^= x >> np.uint64(32)
        h = (h + x) * _WEIGHTS[1 + i // _DIGIT % 3]
        h ^= h >> np.uint64(29)
    h = mix(h)
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | np.arange(m, dtype=np.uint64)
    least = _least(key, threshold - gram + 1)
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    anchor = (least[place] & low).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return place[at], np.diff(np.append(at, total)), anchor[at], owner[at], h[anchor[at]]


def repeated(data: np.ndarray, place: np.ndarray, group: np.ndarray, at: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Which suffixes have an equal one, to the depth of ``threshold`` bytes, of a smaller ``at``.

    place are the suffixes' places in data; only suffixes of one group can be equal.
    """
    out = np.zeros(len(place), dtype=bool)
    order = np.argsort(group, kind="stable")
    label = group[order]
    w = _words(data, ">u8")
    for depth in range(0, threshold + _DIGIT, _DIGIT):
        new = np.ones(len(label) + 1, dtype=bool)
        new[1:-1] = label[1:] != label[:-1]
        alone = new[:-1] & new[1:]
        order = order[~alone]
        if not len(order):
            return out
        label = np.cumsum(new[:-1])[~alone]
        if depth >= threshold:
            break
        digit = w[place[order] + depth].astype(np.uint64)
        if threshold - depth < _DIGIT:
            digit >>= np.uint64(8 * (_DIGIT - (threshold - depth)))
        value, rank = np.unique(digit, return_inverse=True)
        label = label * len(value) + rank
        by = np.argsort(label, kind="stable")
        order, label = order[by], label[by]
    by = np.lexsort((at[order], label))
    order, label = order[by], label[by]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = label[1:] == label[:-1]
    out[order[same]] = True
    return out


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes from each start on as a binary array."""
    end = np.cumsum(size)
    take = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)
    offsets = np.concatenate([[0], end]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[take]))])


def _packed(rows: DataFrame, threshold: int) -> DataFrame:
    """(doc, key, packed) of texts of ``threshold`` bytes or more, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstd.ZstdCompressor(level=3)
        for b in batches:
            for s in slices(b, "text"):
                packed = pa.array([c.compress(t) for t in s.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([s.column("doc"), s.column("key"), packed], ["doc", "key", "packed"])

    return rows.where(F.octet_length("text") >= threshold).select("doc", "key", "text").mapInArrow(run, "doc long, key binary, packed binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, the bytes of their texts, offsets)."""
    d = zstd.ZstdDecompressor()
    for b in batches:
        for s in slices(b, "packed", PACKED_BYTES):
            yield s, *raw(pa.array([d.decompress(x) for x in s.column("packed").to_pylist()], pa.large_binary()))


def _parts(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, the place of the bytes in their text); a long text comes in parts that overlap by less than a suffix."""
    for s, data, first in _unpacked(batches):
        for i in range(0, max(1, len(data) - threshold + 1), PART) if s.num_rows == 1 else (0,):
            part = data[i : i + PART + threshold - 1] if s.num_rows == 1 else data
            yield s, part, np.array([0, len(part)]) if s.num_rows == 1 else first, i


def _anchors(texts: DataFrame, threshold: int, gram: int) -> DataFrame:
    """(name, at, n) of every run; at is rank and place in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, data, first, base in _parts(batches, threshold):
            start, n, _, owner, name = runs(data, first, threshold, gram)
            at = s.column("rank").to_numpy()[owner] << POSITION_BITS | (start - first[owner] + base)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(at), pa.array(n.astype(np.int16))], ["name", "at", "n"])

    return texts.select("rank", "packed").mapInArrow(run, "name long, at long, n smallint")


def _shared(texts: DataFrame, threshold: int, gram: int) -> DataFrame:
    """(name, bytes, anchor, at) of runs whose anchor isn't unique, each once per task's slice; anchor is its place in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, data, first, base in _parts(batches, threshold):
            start, n, anchor, owner, name = runs(data, first, threshold, gram)
            place = start - first[owner] + base
            keep = np.ones(len(start), dtype=bool)
            keep[_listed(owner, place, _places(s.column("unique")))] = False
            start, n, anchor, name, owner, place = (x[keep] for x in (start, n, anchor, name, owner, place))
            at = s.column("rank").to_numpy()[owner] << POSITION_BITS | place
            for i in range(0, len(start), 1 << 15):
                j = slice(i, i + (1 << 15))
                coded = _gather(data, start[j], n[j] + threshold - 1).dictionary_encode()
                code = np.asarray(coded.indices)
                least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
                np.minimum.at(least, code, at[j])
                one = np.unique(code, return_index=True)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[j][one].view(np.int64)), coded.dictionary.cast(pa.binary()), pa.array((anchor[j] - start[j])[one].astype(np.int16)), pa.array(least)], ["name", "bytes", "anchor", "at"]
                )

    return texts.select("rank", "packed", "unique").mapInArrow(run, "name long, bytes binary, anchor smallint, at long")


def _places(lists: pa.Array) -> pa.Array:
    """Lists of runs as lists of their first places."""
    values = np.asarray(lists.flatten()) // _RUN
    size = np.where(np.asarray(lists.is_valid()), np.diff(np.asarray(lists.offsets)), 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values))


def _finer(rows: DataFrame, width: int, threshold: int) -> DataFrame:
    """Runs cut into ones of at most ``width`` suffixes, named by what all suffixes of their class have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, data, anchors, ats = [], [], [], []
            for text, anchor, at in zip(b.column("bytes").to_pylist(), b.column("anchor").to_pylist(), b.column("at").to_pylist(), strict=True):
                last = len(text) - threshold
                for q in range((anchor - last) // width, anchor // width + 1):  # classes of places before the anchor
                    a, z = max(anchor - q * width - width + 1, 0), min(anchor - q * width, last)
                    core = text[anchor - q * width : anchor - q * width - width + 1 + threshold]
                    name.append(xxhash.xxh3_64_intdigest(core, q))
                    data.append(text[a : z + threshold])
                    anchors.append(anchor - a)
                    ats.append(at + a)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(name, np.uint64).view(np.int64)), pa.array(data, pa.binary()), pa.array(anchors, pa.int16()), pa.array(ats, pa.int64())], ["name", "bytes", "anchor", "at"])

    return rows.mapInArrow(run, "name long, bytes binary, anchor smallint, at long")


def _sorted(rows: DataFrame, threshold: int) -> DataFrame:
    """(rank, run) of the first places among ``rows``, which come by name."""

    def firsts(t: pa.Table) -> pa.RecordBatch:
        data, off = raw(t.column("bytes").combine_chunks().cast(pa.large_binary()))
        n = np.diff(off) - threshold + 1
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = t.column("at").to_numpy()[owner] + step
        name = np.unique(t.column("name").to_numpy(), return_inverse=True)[1]
        group = name[owner] * (2 * threshold) + (t.column("anchor").to_numpy()[owner] - step)
        kept = ~repeated(data, off[owner] + step, group, at, threshold)
        begin = kept.copy()
        begin[1:] &= ~kept[:-1] | (owner[1:] != owner[:-1])
        end = kept.copy()
        end[:-1] &= ~kept[1:] | (owner[1:] != owner[:-1])
        a, z = np.flatnonzero(begin), np.flatnonzero(end)
        run = (at[a] & (1 << POSITION_BITS) - 1) * _RUN + (z - a + 1)
        return pa.RecordBatch.from_arrays([pa.array(at[a] >> POSITION_BITS), pa.array(run)], ["rank", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("bytes").nbytes
            if size < SORT_BYTES:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            names = t.column("name").to_numpy()
            cut = int(np.flatnonzero(names == names[-1])[0])  # the last value may go on
            if cut:
                yield firsts(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(x.column("bytes").nbytes for x in held)
        if held:
            yield firsts(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "rank long, run long")


def _heavy(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of values with at most ``most`` runs, the others or None)."""
    names = checkpointed(rows.groupBy("name").agg(F.count("*").alias("runs")).where(F.col("runs") > most).select("name"))
    if names.isEmpty():
        return rows, None
    return join_small(rows, names, "name", "left_anti"), join_small(rows, names, "name", "left_semi")


def _first_places(rows: DataFrame, threshold: int, heavy: int) -> DataFrame:
    """(rank, run) of the first place of every string in ``rows``, the runs of anchors that are shared."""
    n = _partitions(rows.sparkSession)
    out = None
    for width in (FINER, 1, None):
        combined = saved(rows.groupBy("name", "bytes").agg(F.min("anchor").alias("anchor"), F.min("at").alias("at")), "runs")
        # a digit of the whole depth leaves one run a value
        light, rest = _heavy(combined, heavy) if width is not None else (combined, None)
        got = _sorted(light.repartition(n, "name").sortWithinPartitions("name"), threshold)
        out = got if out is None else out.unionByName(got)
        if rest is None:
            return out
        rows = _finer(rest, width, threshold)
    return out


def _kept(texts: DataFrame, threshold: int) -> DataFrame:
    """(rank, spans, kept) of texts that lose bytes; the lists ``unique`` and ``firsts`` hold the places that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, data, first in _unpacked(batches):
            ranks, spans, kept = [], [], []
            lists = [s.column("unique"), s.column("firsts")]
            for i, rank in enumerate(s.column("rank").to_pylist()):
                stay = np.concatenate([np.asarray(x[i].values) if x[i].is_valid else np.zeros(0, np.int64) for x in lists]).astype(np.int64)
                size = int(first[i + 1] - first[i])
                a, n = stay // _RUN, stay % _RUN
                if n.sum() >= size - threshold + 1:
                    continue
                order = np.argsort(a)
                a, z = a[order], (a + n)[order]
                begin, end = np.append(0, z), np.append(a, size - threshold + 1)  # runs of places that go
                gone = begin < end
                begin, end = begin[gone], end[gone] + threshold - 1
                apart = np.ones(len(begin), dtype=bool)
                apart[1:] = begin[1:] > end[:-1]
                begin, end = begin[apart], end[np.append(np.flatnonzero(apart)[1:] - 1, len(end) - 1)]
                text = data[first[i] : first[i + 1]].tobytes()
                ranks.append(rank)
                spans.append([{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), size], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["rank", "spans", "kept"])

    return texts.select("rank", "packed", "unique", "firsts").mapInArrow(run, "rank long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, threshold: int = THRESHOLD, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """``keep`` columns (all, by default), n_bytes, sha256 (binary, of the whole text), spans and kept.

    spans are the maximal runs of removed bytes, [start, end); kept (binary) holds the other bytes.
    Both are null where nothing is removed.
    """
    if not gram % _DIGIT == 0 < gram <= threshold or threshold - gram + 1 >= _RUN:
        raise ValueError("gram is a multiple of 8, at most threshold and more than threshold - 127")
    spark = docs.sparkSession
    new = ("n_bytes", "sha256", "spans", "kept")
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    sha = F.unhex(F.sha2(body, 256))
    sized = docs.select(*own, doc.alias("__doc"), F.octet_length(body).cast("long").alias("n_bytes"), sha.alias("sha256")).withColumn("__key", F.substring("sha256", 1, 16))
    if text not in own:  # short rows are kept, texts are read again
        sized = saved(sized, "suffixes")
    ranked = _ranked(sized.select(F.col("n_bytes").alias("n_words"), F.col("__doc").alias("doc"), F.col("__key").alias("key")), threshold)
    rows = docs.select(doc.alias("doc"), F.substring(sha, 1, 16).alias("key"), body.alias("text"))
    n = _partitions(spark)
    one = _packed(rows, threshold).join(ranked, ["doc", "key"]).select("rank", "packed").repartition(n, "rank").groupBy("rank").agg(F.first("packed").alias("packed"))
    tables = []
    try:
        tables.append(_bucketed(one, "rank"))
        texts = spark.table(tables[0][0])
        counted = _anchors(texts, threshold, gram).groupBy("name").agg(F.count("*").alias("runs"), F.min("at").alias("at"), F.min("n").alias("n"))
        run = F.col("at").bitwiseAND((1 << POSITION_BITS) - 1) * _RUN + F.col("n")
        lists = counted.where("runs = 1").select(F.shiftright("at", POSITION_BITS).alias("rank"), run.alias("run"))
        tables.append(_bucketed(lists.repartition(n, "rank").groupBy("rank").agg(F.collect_list("run").alias("unique")), "rank"))
        texts = texts.join(spark.table(tables[1][0]), "rank", "left")
        firsts = _first_places(_shared(texts, threshold, gram), threshold, heavy)
        firsts = firsts.groupBy("rank").agg(F.collect_list("run").alias("firsts"))
        lost = saved(_kept(texts.join(firsts, "rank", "left"), threshold), "suffixes")
    finally:
        _dropped(spark, *tables)
    addressed = ranked.join(lost, "rank", "left").select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), "rank", F.col("spans").alias("__spans"), F.col("kept").alias("__kept"))
    out = sized.join(addressed, ["__doc", "__key"], "left")
    copy = F.col("rank").isNull() & (F.col("n_bytes") >= threshold)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(*own, "n_bytes", "sha256", F.when(copy, whole).otherwise(F.col("__spans")).alias("spans"), F.when(copy, F.lit(b"")).otherwise(F.col("__kept")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    sha = F.when(F.col("kept").isNull(), F.lower(F.hex("sha256"))).otherwise(F.sha2("kept", 256))
    spans = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans"))
    return out.select("doc_id", "n_bytes", F.coalesce(removed, F.lit(0)).alias("n_removed"), spans.cast("long").alias("n_spans"), sha.alias("kept_sha256"))


#: Windows as hexadecimal text, as every engine can cut text.
ORACLE = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (
  SELECT r, unnest(generate_series(0, len(x) // 2 - {THRESHOLD})) AS i, x FROM d WHERE len(x) >= {2 * THRESHOLD}
), w AS MATERIALIZED (
  SELECT r, i, md5_number(substring(x, 2 * i + 1, {2 * THRESHOLD})) AS h FROM p
), m AS (
  SELECT r, i FROM w JOIN (SELECT h, min((r, i)) AS f FROM w GROUP BY h HAVING count(*) > 1) USING (h) WHERE (r, i) <> f
), g AS (
  SELECT r, i, i > lag(i) OVER o + {THRESHOLD} OR lag(i) OVER o IS NULL AS fresh FROM m WINDOW o AS (PARTITION BY r ORDER BY i)
), n AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g
), s AS (SELECT r, min(i) AS a, max(i) + {THRESHOLD} AS z FROM n GROUP BY r, k
), t AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM s
), k AS (
  SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substring(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS kept FROM t JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.r IS NULL THEN x ELSE kept || substring(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
