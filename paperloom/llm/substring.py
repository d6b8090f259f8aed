"""Removal of repeated word windows, found by recompression.

A document is read as a row of words.  ``ROUNDS`` rounds of recompression shorten it: runs of one
symbol become one symbol, then neighbours (a, b) with a in the left and b in the right half of
the alphabet (by a hash of round and symbol) become one.  Symbols are named by hashes of what
they stand for, so equal words get equal names in all documents without a shuffle per round.
Each symbol keeps the range of words that it depends on; inside equal passages these symbols are
the same.  Every window of ``WINDOW`` words is assigned to one symbol whose range lies inside it,
the one with the least hash of its range; that is a function of the window's words alone, so equal
windows have equal symbols.

1. Texts with the same words are one text from here on, the first; others repeat it wholly.
2. Symbols (those that windows are assigned to) are counted over all texts.  Windows of a symbol
   that occurs once can't repeat.  Only windows of shared symbols are looked at further.
3. Those are compared by 128-bit hashes: the text with the least rank has each window first.
4. Words covered by a window that isn't the first are removed.

Counts and firsts are aggregations that are combined before the shuffle, so a passage in a third
of all documents costs a row per task.  What a document needs to know comes back as lists of its
own positions, joined with its text by rank; texts are written once, compressed and bucketed by
rank, so these joins move no text.  Nothing is collected to the driver.

Names and comparisons rely on hashes: 64 bits where a collision only costs work (a symbol then
counts as shared), 128 bits where it would remove words.  The two halves come from separate hashes of
the words' bytes, so words that agree in one half don't agree in the other.

Defined results: a null text has no words; null ids come after all others; texts with one id
are ordered by their words' hash; repeated rows (same id and words) are one document with one
result; texts shorter than a window lose nothing; an empty table gives an empty one; columns of
the input named like an output are replaced.  Ranks are below 2**34 and positions below 2**29.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import checkpointed, delete, fresh_dir, join_small, saved
from paperloom.llm.words import mix, normal_form, prefix, range_hash, raw, slices, split

WINDOW = 20
ROUNDS = 2
POSITION_BITS = 29
PACKED_BYTES = 128 << 10
_BASES = (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high) of the symbols after ``rounds`` rounds; words [low, high) determine each.

    h are word hashes, first the words before each text.  A symbol that depends on where its text
    begins or ends gets a range that reaches beyond the text.
    """
    n = len(h)
    name = h
    low, high = np.arange(n), np.arange(1, n + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for r in range(rounds):
        begins, ends = _edges(text)
        before = np.where(begins, first[text] - 1, np.concatenate([[0], low[:-1]]))
        after = np.where(ends, first[text + 1] + 1, np.concatenate([high[1:], [0]]))
        new = begins.copy()
        new[1:] |= name[1:] != name[:-1]
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(name)))
        last = at + length - 1
        name = np.where(length > 1, mix(name[at] ^ mix(length.astype(np.uint64))), name[at])
        low, high, text = before[at], after[last], text[at]

        begins, ends = _edges(text)
        right = (mix(name + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~ends[:-1]
        second = np.zeros(len(name), dtype=bool)
        second[1:] = pair[:-1]
        nxt = np.concatenate([name[1:], name[:1]])
        joined = mix(name * np.uint64(3) + mix(nxt))
        before = np.where(begins, first[text] - 1, np.concatenate([[0], low[:-1]]))
        after = np.where(ends, first[text + 1] + 1, np.concatenate([high[1:], [0]]))
        high = np.where(pair | ~right, after, high)  # a pair ends with its second; a left symbol alone has seen its neighbour
        low = np.where(right & ~second, before, low)
        keep = ~second
        name = np.where(pair, joined, name)[keep]
        low, high, text = low[keep], high[keep], text[keep]
    return name, low, high


def _edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each symbol is its text's first, and its last."""
    change = text[1:] != text[:-1]
    one = np.ones(min(1, len(text)), dtype=bool)
    return np.concatenate([one, change]), np.concatenate([change, one])


class Parsed:
    """Windows of a run of texts, and the groups of neighbouring windows with one symbol."""

    def __init__(self, column: pa.Array, window: int):
        self.words = w = split(column)
        self.window = window
        h, other = w.hashes()
        n, texts = len(h), len(w.text) - 1
        self.sums = prefix(h, _BASES[0]), prefix(other, _BASES[1])
        count = np.maximum(w.per_text - window + 1, 0)
        stop = np.cumsum(count)
        self.owner = np.repeat(np.arange(texts), count)  # of windows
        total = int(stop[-1]) if texts else 0
        self.start = np.arange(total) - np.repeat(stop - count, count) + w.first[self.owner]
        _, low, high = recompress(h, w.first)
        inside = (low >= 0) & (high <= n)
        inside[inside] &= high[inside] - low[inside] <= window
        order = np.full(len(low), _NONE)
        order[inside] = mix(range_hash(self.sums[0], low[inside], high[inside], _BASES[0]) + (high - low)[inside].astype(np.uint64))
        a = np.searchsorted(low, self.start, "left")
        z = np.searchsorted(high, self.start + window, "right")
        best = _least(order, a, z)
        none = best < 0
        name = np.where(none, np.uint64(0), order[best])
        if none.any():  # windows without a symbol stand for themselves
            name[none] = self.hashes(np.flatnonzero(none))[0]
        new = np.ones(total, dtype=bool)
        if total:
            new[1:] = none[1:] | none[:-1] | (best[1:] != best[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.head = np.flatnonzero(new)  # first window of each group
        self.group = np.cumsum(new) - 1
        self.name = name[self.head]

    def hashes(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of windows."""
        s = self.start[windows]
        return tuple(mix(range_hash(p, s, s + self.window, b)) for p, b in zip(self.sums, _BASES, strict=True))

    @property
    def position(self) -> np.ndarray:
        """Each window's start in its text."""
        return self.start - self.words.first[self.owner]

    def shared(self, unique: pa.Array) -> np.ndarray:
        """Windows of groups whose first positions are not in the texts' lists ``unique``."""
        once = np.zeros(len(self.head), dtype=bool)
        once[_listed(self.owner[self.head], self.position[self.head], unique)] = True
        return np.flatnonzero(~once[self.group]) if len(once) else np.zeros(0, dtype=np.int64)

    def first_inside(self, windows: np.ndarray) -> np.ndarray:
        """Which of ``windows`` have no equal before them in their text."""
        a, b = self.hashes(windows)
        key = mix(a ^ mix(b ^ mix(self.owner[windows].astype(np.uint64))))
        out = np.zeros(len(windows), dtype=bool)
        out[np.unique(key, return_index=True)[1]] = True
        return out


def _least(order: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The index of the least of order[a:z], the first of equals; -1 where there is none."""
    out = np.full(len(a), -1, dtype=np.int64)
    width = z - a
    level = np.arange(len(order))
    p = 1
    while len(level):
        at = np.flatnonzero((width >= p) & (width < 2 * p))
        if len(at):
            x, y = level[a[at]], level[z[at] - p]
            out[at] = np.where(order[y] < order[x], y, x)
        if not (width >= 2 * p).any():
            break
        x, y = level[:-p], level[p:]
        level = np.where(order[y] < order[x], y, x)
        p *= 2
    found = out >= 0
    out[found] = np.where(order[out[found]] == _NONE, -1, out[found])
    return out


def _listed(owner: np.ndarray, position: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Indices of the (owner, position) pairs, ascending, that are in the owners' lists."""
    size = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.flatten()).astype(np.int64)
    valid = np.asarray(lists.is_valid())
    keys = np.sort((np.repeat(np.arange(len(lists)), np.where(valid, size, 0)) << POSITION_BITS) | values)
    mine = (owner << POSITION_BITS) | position
    at = np.searchsorted(keys, mine)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == mine[hit]
    return np.flatnonzero(hit)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucketed(df: DataFrame, by: str) -> tuple[str, str]:
    """(name, path) of ``df``, dealt out to ``_partitions`` ``by``, as a table in the shared folder that joins on ``by`` needn't shuffle."""
    name, path = f"paperloom_{uuid.uuid4().hex}", fresh_dir(df.sparkSession, "bucketed")
    df.write.bucketBy(_partitions(df.sparkSession), by).option("path", path).option("compression", "zstd").saveAsTable(name)
    return name, path


def _dropped(spark: SparkSession, *tables: tuple[str, str]) -> None:
    """Takes tables that are done with out of the catalog and deletes their files."""
    for name, path in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def _row_schema(df: DataFrame, own: list[str], more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema] + [more])


def _hashed(rows: DataFrame, own: list[str]) -> DataFrame:
    """``own`` columns, n_words and words_sha256 (binary, of the words joined by single spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__text"):
                w, texts = _normal(s.column("__text"))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), pa.array(w), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], [*own, "n_words", "words_sha256"])

    return rows.mapInArrow(run, _row_schema(rows, own, "n_words long, words_sha256 binary"))


def _normal(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Number of words of each text, and the words joined by single spaces."""
    w = split(column)
    data, start, end = normal_form(w)
    start, end, whole = np.append(start, len(data)), np.append(end, len(data)), data.tobytes()
    a, z = start[w.first[:-1]].tolist(), np.maximum(start[w.first[1:]] - 1, 0).tolist()
    return w.per_text, [whole[x:y] if y > x else b"" for x, y in zip(a, z, strict=True)]


def _packed(rows: DataFrame, window: int) -> DataFrame:
    """(doc, key, packed) of texts with a window: the words joined by spaces, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstd.ZstdCompressor(level=1)
        for b in batches:
            for s in slices(b, "__text"):
                n, texts = _normal(s.column("__text"))
                at = np.flatnonzero(n >= window)
                chosen = [texts[i] for i in at]
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc").take(pa.array(at)), pa.array([hashlib.sha256(t).digest()[:16] for t in chosen], pa.binary()), pa.array([c.compress(t) for t in chosen], pa.binary())],
                    ["doc", "key", "packed"],
                )

    return rows.mapInArrow(run, "doc long, key binary, packed binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    d = zstd.ZstdDecompressor()
    for b in batches:
        for s in slices(b, "packed", PACKED_BYTES):
            yield s, pa.array([d.decompress(x) for x in s.column("packed").to_pylist()], pa.binary())


def _symbols(texts: DataFrame, window: int) -> DataFrame:
    """(name, rank, position) of each symbol that windows are assigned to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, column in _unpacked(batches):
            p = Parsed(column, window)
            rank = s.column("rank").to_numpy()[p.owner[p.head]]
            yield pa.RecordBatch.from_arrays([pa.array(p.name.view(np.int64)), pa.array(rank), pa.array(p.position[p.head].astype(np.int32))], ["name", "rank", "position"])

    return texts.select("rank", "packed").mapInArrow(run, "name long, rank long, position int")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, at) of windows of shared symbols, each once per text; at is rank and position in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, column in _unpacked(batches):
            p = Parsed(column, window)
            chosen = p.shared(s.column("unique"))
            chosen = chosen[p.first_inside(chosen)]
            a, b = p.hashes(chosen)
            at = s.column("rank").to_numpy()[p.owner[chosen]] << POSITION_BITS | p.position[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(at)], ["h1", "h2", "at"])

    return texts.select("rank", "packed", "unique").mapInArrow(run, "h1 long, h2 long, at long")


def _kept(texts: DataFrame, window: int) -> DataFrame:
    """(rank, n_removed, kept) of texts that lose words; kept are the other words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, column in _unpacked(batches):
            p = Parsed(column, window)
            chosen = p.shared(s.column("unique"))
            fresh = p.first_inside(chosen)
            listed = np.zeros(len(chosen), dtype=bool)
            listed[_listed(p.owner[chosen], p.position[chosen], s.column("firsts"))] = True
            gone = p.start[chosen[~(fresh & listed)]]
            change = np.zeros(len(p.words.start) + 1, dtype=np.int64)
            np.add.at(change, gone, 1)
            np.add.at(change, gone + window, -1)
            covered = np.cumsum(change[:-1]) > 0
            removed = np.bincount(p.words.owner[covered], minlength=len(column))
            rows = np.flatnonzero(removed)
            data, off = raw(column)
            texts_out = []
            for i in rows.tolist():
                a, z = p.words.first[i], p.words.first[i + 1]
                keep = ~covered[a:z]
                # words and the space after each stand next to each other in the text
                cut = np.repeat(keep, p.words.end[a:z] - p.words.start[a:z] + 1)[: off[i + 1] - off[i]]
                texts_out.append(data[off[i] : off[i + 1]][cut].tobytes().rstrip(b" "))
            yield pa.RecordBatch.from_arrays([s.column("rank").take(pa.array(rows)), pa.array(removed[rows]), pa.array([t.decode() for t in texts_out], pa.string())], ["rank", "n_removed", "kept"])

    return texts.select("rank", "packed", "unique", "firsts").mapInArrow(run, "rank long, n_removed long, kept string")


def _ranked(narrow: DataFrame, window: int) -> DataFrame:
    """(doc, key, rank): the first row of each text with a window; ranks ascend with (doc, key) without gaps."""
    first = narrow.where(F.col("n_words") >= window).groupBy("key").agg(F.min("doc").alias("doc"))
    order = first.repartitionByRange("doc", "key").sortWithinPartitions("doc", "key")
    loose = checkpointed(order.withColumn("loose", F.monotonically_increasing_id()))
    part = F.shiftright("loose", 33)
    sizes = loose.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = join_small(loose.withColumn("part", part), before, "part", "inner")
    return checkpointed(ranked.select("doc", "key", (F.col("before") + F.col("loose").bitwiseAND((1 << 33) - 1)).alias("rank")))


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, window: int = WINDOW) -> DataFrame:
    """``keep`` columns (all, by default), n_words, n_removed, words_sha256 and kept.

    kept is null where nothing is removed, else the words left, joined by single spaces;
    words_sha256 (binary) is of all words of the text, joined so.
    """
    new = ("n_words", "n_removed", "words_sha256", "kept")
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("__doc")
    rows = docs.select(*own, F.col(text).cast("string").alias("__text"), doc)
    key = F.substring("words_sha256", 1, 16)
    sized = _hashed(rows, [*own, "__doc"]).withColumn("__key", key)
    if text not in own:  # short rows are kept, texts are read again
        sized = saved(sized, "substring")
    ranked = _ranked(sized.select("n_words", F.col("__doc").alias("doc"), F.col("__key").alias("key")), window)
    rows = rows.select("__text", F.col("__doc").alias("doc"))
    spark = docs.sparkSession
    n = _partitions(spark)
    one = _packed(rows, window).join(ranked, ["doc", "key"]).select("rank", "packed").repartition(n, "rank").groupBy("rank").agg(F.first("packed").alias("packed"))
    tables = []
    try:
        tables.append(_bucketed(one, "rank"))
        texts = spark.table(tables[0][0])
        counted = _symbols(texts, window).groupBy("name").agg(F.count("*").alias("n"), F.min("rank").alias("rank"), F.min("position").alias("position"))
        lists = counted.where("n = 1").repartition(n, "rank").groupBy("rank").agg(F.collect_list("position").alias("unique"))
        tables.append(_bucketed(lists, "rank"))
        with_unique = texts.join(spark.table(tables[1][0]), "rank", "left")
        firsts = _windows(with_unique, window).groupBy("h1", "h2").agg(F.min("at").alias("at"))
        mask = (1 << POSITION_BITS) - 1
        of = firsts.select(F.shiftright("at", POSITION_BITS).alias("rank"), F.col("at").bitwiseAND(mask).cast("int").alias("position"))
        of = of.groupBy("rank").agg(F.collect_list("position").alias("firsts"))
        lost = saved(_kept(with_unique.join(of, "rank", "left"), window), "substring")
    finally:
        _dropped(spark, *tables)
    addressed = ranked.join(lost, "rank", "left").select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), "rank", "n_removed", F.col("kept").alias("__kept"))
    out = sized.join(addressed, ["__doc", "__key"], "left")
    copy = F.col("rank").isNull() & (F.col("n_words") >= window)
    return out.select(
        *own, "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        "words_sha256", F.when(copy, F.lit("")).otherwise(F.col("__kept")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, keep=("doc_id",))
    sha = F.when(F.col("kept").isNull(), F.lower(F.hex("words_sha256"))).otherwise(F.sha2("kept", 256))
    return out.select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS i, words FROM d WHERE len(words) >= 20
), w AS (
  SELECT doc_id, i, sha256(array_to_string(words[i : i + 19], ' ')) AS h FROM p
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM w) WHERE n > 1
), g AS (
  SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(generate_series(0, 19)) AS k)
), a AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), k AS (
  SELECT a.doc_id, count(g.i) AS n_removed, string_agg(a.word, ' ' ORDER BY a.i) FILTER (g.i IS NULL) AS kept
  FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
