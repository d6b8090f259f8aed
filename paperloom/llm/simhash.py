"""Near duplicates by SimHash fingerprints and pivot distance tables.

1. ``fingerprints``: 64-bit majority of the XXH64 hashes of a text's word shingles.
2. Equal fingerprints are one node from here on, so copies cost nothing.
3. ``pivot_table``: each fingerprint's Hamming distances to ``PIVOTS`` fixed reference
   fingerprints, packed a byte each into longs.  Two fingerprints whose distances to one pivot
   differ by more than d are more than d bits apart (triangle inequality).
4. Candidates share the bits of some set of blocks: with the 64 bits in b blocks, fingerprints at
   most d bits apart agree in b - d blocks at least, so keys over all sets of b - d blocks lose
   none.  b grows with the number of fingerprints, so that keys stay about as long as its
   logarithm; every b gives the same links.  A key that too many fingerprints share is replaced by
   finer ones in the same way.
5. Within a key, rows are sorted by their distance to the first pivot and compared only within d
   of it; pairs are discarded by the largest coordinate difference over all pivots, and the
   survivors are verified on the fingerprints themselves.  Finest keys with over ``TILE``
   fingerprints are dealt out as pairs of tiles of about that size, so no task holds such a group,
   and a task passes on a spanning star of each connected set, not its pairs.
6. Connected components over the stars; the least document id names each.

``keep_one`` is the pipeline's stage: copies up to four bits apart are found so, over five-word
shingles, then verified and completed to all pairs of a similarity of 0.8, see ``near_linked``.

Defined results: a null or empty text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; null ids are never the least of a component (a
component of null ids alone has a null name); repeated rows get one row each; an empty table
gives an empty one; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.graph import components
from paperloom.llm.shared import checkpointed, delete, drop, fresh_dir, join_small, release, workspace
from paperloom.llm.words import mix, normal_form, slices, split

SHINGLE = 4
BITS = 4
SEED = 42
PIVOTS = 16
TILE = 512
LEVELS = 2


def simhash(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprints of texts, as uint64."""
    return wide_simhash(column, shingle, seed, 1)[:, 0]


def _shingles(column: pa.Array, shingle: int, seed: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, indices of those with words, shingles of each, their running total, hashes of all shingles)."""
    w = split(column)
    data, start, end = normal_form(w, lower=True)
    per = w.per_text
    full = np.flatnonzero(per > 0)
    if not len(full):
        return len(per), full, full, full, np.zeros(0, np.uint64)
    count = np.maximum(per[full] - shingle + 1, 1)
    stop = np.cumsum(count)
    ramp = np.arange(stop[-1]) - np.repeat(stop - count, count)
    first = np.repeat(w.first[full], count) + ramp
    last = np.minimum(first + shingle, np.repeat(w.first[full + 1], count)) - 1
    whole, digest = data.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(whole[a:z], seed) for a, z in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    return len(per), full, count, stop, h


def wide_simhash(column: pa.Array, shingle: int, seed: int = SEED, n_words: int = 4) -> np.ndarray:
    """Fingerprints of ``n_words`` words of 64 bits; words after the first come from the shingles' hashes, mixed again."""
    return _votes(_shingles(column, shingle, seed), n_words)


def _votes(hashed, n_words: int) -> np.ndarray:
    n, full, count, stop, h = hashed
    out = np.zeros((n, n_words), dtype=np.uint64)
    for k in range(n_words):
        own = h if k == 0 else mix(h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        for a in range(0, len(full), 256):
            z = min(a + 256, len(full))
            lo, hi = stop[a] - count[a], stop[z - 1]
            bits = np.unpackbits(own[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, stop[a:z] - count[a:z] - lo, axis=0, dtype=np.int32)
            out[full[a:z], k] = np.packbits(2 * votes > count[a:z, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all but the text, by default) and fp, the fingerprint as a signed long."""
    own = [c for c in (docs.columns if keep is None else keep) if c != "fp" and (keep is not None or c != text)]
    rows = docs.select(*own, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__text"):
                fp = simhash(s.column("__text")).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), pa.array(fp)], [*own, "fp"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema] + ["fp long"])
    return rows.mapInArrow(run, schema)


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints, as signed longs."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


def pivot_table(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp) with p0, p1, ...: eight pivot distances in each long, a byte each."""
    refs = pivots()
    packed = {}
    for k in range(0, len(refs), 8):
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i) for i, p in enumerate(refs[k : k + 8])]
        packed[f"p{k // 8}"] = sum(parts[1:], parts[0])
    return nodes.withColumns(packed)


def blocks_for(n: int, d: int = BITS) -> int:
    """The number of blocks with which a key is at least about as long as log2 of n fingerprints."""
    b = d + 2
    while b < 16 and 64 * (b - d) / b < np.log2(max(n, 2)) + 2:
        b += 1
    return b


def _cut(bits: list[int], blocks: int, least: int) -> list[int]:
    """Masks of all sets of ``least`` blocks, the bits being cut into ``blocks`` of about one size."""
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    part = [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in itertools.combinations(range(blocks), least)]


def block_masks(blocks: int, d: int = BITS) -> list[int]:
    """Masks of the sets of blocks, one of which any two fingerprints at most d bits apart agree in."""
    return _cut(list(range(64)), blocks, blocks - d)


def finer_masks(masks: list[int], d: int = BITS) -> list[int]:
    """For each mask, it and two of the d + 2 blocks that the other bits are cut into: as many masks for each, in a row."""
    return [m | x for m in masks for x in _cut([b for b in range(64) if not m >> b & 1], d + 2, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(d: int):
    """Rows sorted by group (level, kind, key, low, high) -> edges (a, b) from each linked row to the least of its set.

    Rows have an id, which is their fingerprint, and pivot distances packed into p0 and p1.
    """

    by = ("level", "kind", "key", "low", "high")

    def links(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = len(c["id"])
        group = np.cumsum(np.concatenate([[0], np.any([c[k][1:] != c[k][:-1] for k in by], axis=0)])) if n else np.zeros(0, int)
        table = np.column_stack([c["p0"], c["p1"]]).astype("<i8").view("u1").reshape(n, -1).astype(np.int16)
        order = np.lexsort((table[:, 0], group))
        group, table, ids = group[order], table[order], c["id"][order]
        fp = ids.view(np.uint64)
        side, cross = c["tile"][order], (c["low"] != c["high"])[order]
        at = group * 1024 + table[:, 0]
        until = np.searchsorted(at, at + d, "right")  # rows of the group within d by the first pivot
        label = np.arange(n)
        low, high = [], []
        live = np.flatnonzero(until > np.arange(n) + 1)
        lag = 1
        while len(live):
            i, j = live, live + lag
            ok = ~cross[i] | (side[i] != side[j])
            i, j = i[ok], j[ok]
            for k in range(1, table.shape[1]):  # the largest coordinate difference, pivot by pivot
                near = np.abs(table[i, k] - table[j, k]) <= d
                i, j = i[near], j[near]
            same = np.bitwise_count(fp[i] ^ fp[j]) <= d
            low.append(i[same])
            high.append(j[same])
            lag += 1
            live = live[live + lag < until[live]]
        if not low:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.concatenate(low), np.concatenate(high)
        while True:
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            np.minimum.at(new, label[i], least)
            np.minimum.at(new, label[j], least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        x = np.flatnonzero(label != np.arange(n))
        return ids[x], ids[label[x]]

    return _by_group(links, by, ("tile", "id", "p0", "p1"), ["a", "b"])


def _by_group(links, by: tuple[str, ...], more: tuple[str, ...], out_names: list[str]):
    """A function for mapInArrow that hands ``links`` the columns of whole groups of rows sorted by ``by``."""
    names = (*by, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def out(c: dict[str, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in links(c)], out_names)

        for batch in batches:
            new = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            held = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in names}
            changes = np.flatnonzero(np.any([held[k][1:] != held[k][:-1] for k in by], axis=0))
            if len(changes):  # the last group may go on in the next batch
                cut = changes[-1] + 1
                yield out({k: v[:cut] for k, v in held.items()})
                held = {k: v[cut:] for k, v in held.items()}
        if held is not None and len(held["id"]):
            yield out(held)

    return run


def linked(nodes: DataFrame, d: int = BITS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``nodes`` (fp) at most d bits apart.

    Each edge joins fingerprints that a chain of verified pairs connects.  A key that more than
    ``tile`` fingerprints share is replaced by finer ones: its other bits are cut into d + 2 blocks,
    of which two at least agree as well, and so on up to ``LEVELS`` times.  Only what is still
    larger is dealt out as pairs of tiles.
    """
    met = candidates(nodes, d, tile)
    by = ["level", "kind", "key", "low", "high"]
    return met.repartition(*by).sortWithinPartitions(*by).mapInArrow(_stars(d), "a long, b long")


def candidates(nodes: DataFrame, d: int = BITS, tile: int = TILE) -> DataFrame:
    """Fingerprints by the groups (level, kind, key, low, high) that they are compared in, see ``linked``."""
    masks = block_masks(blocks_for(nodes.count(), d), d)
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for i, m in enumerate(masks)])
    keyed = checkpointed(pivot_table(nodes).withColumn("k", F.explode(keys)).select("k.*", F.col("fp").alias("id"), "p0", "p1"))
    met = None
    for level in range(LEVELS + 1):
        groups = checkpointed(keyed.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1"))
        large = groups.where(F.col("n") > tile) if level < LEVELS else groups.limit(0)
        last = large.isEmpty()
        tiles = _tiled(keyed, groups if last else groups.where(F.col("n") <= tile), ["kind", "key"], tile).withColumn("level", F.lit(level)).select("level", "kind", "key", "low", "high", "tile", "id", "p0", "p1")
        met = tiles if met is None else met.unionByName(tiles)
        if last:
            break
        was, masks = len(masks), finer_masks(masks, d)
        table = [(k * was // len(masks), k, _signed(m)) for k, m in enumerate(masks)]  # 126 * 15 * 15 rows at most
        table = nodes.sparkSession.createDataFrame(table, "kind int, finer int, mask long").hint("broadcast")
        again = keyed.join(large.select("kind", "key"), ["kind", "key"], "left_semi").join(table, "kind")
        keyed = checkpointed(again.select(F.col("finer").alias("kind"), F.col("id").bitwiseAND(F.col("mask")).alias("key"), "id", "p0", "p1"))
    return met


def _tiled(keyed: DataFrame, groups: DataFrame, key: list[str], tile: int) -> DataFrame:
    """Rows (key, id, ...) of ``groups`` (key, n), with tile, once for each pair (low, high) of tiles of their key that theirs is in."""
    met = keyed.join(groups, key)
    tiles = F.ceil(F.col("n") / tile).cast("int")
    met = met.withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("id"), tiles).cast("int")})
    each = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("low"), F.greatest(t, F.col("tile")).alias("high"))
    )
    return met.withColumn("t", F.explode(each)).withColumns({"low": F.col("t.low"), "high": F.col("t.high")}).drop("t", "n", "tiles")


#: Near copies: words of a shingle; texts sampled for common shingles, the fewest of them one is in, and most kept; bits of a parity.
NEAR_SHINGLE = 5
SAMPLE_TEXTS = 5_000
COMMON_LEAST = 4
COMMON_MOST = 100_000
PARITY = 512


def _shingle_sets(column: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
    """(texts, index of its text for each shingle, hash of the shingle): each distinct shingle of a text once, sorted by both."""
    n, full, count, _, h = _shingles(column, NEAR_SHINGLE, SEED)
    owner = np.repeat(full, count)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return n, owner[new], h[new]


def _set_ids(n: int, owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each text's set of shingles."""
    total = np.zeros(n, dtype=np.uint64)
    np.add.at(total, owner, mix(h ^ np.uint64(0x9E3779B97F4A7C15)))
    return mix(total + np.bincount(owner, minlength=n).astype(np.uint64)).view(np.int64)


def _parities(n: int, owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each set ``PARITY`` bits: whether an odd number of its hashes fall on each."""
    at = owner * PARITY + (mix(h) % np.uint64(PARITY)).astype(np.int64)
    odd = np.bincount(at, minlength=n * PARITY).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, PARITY), axis=1)


def _wide_parities(n: int, size: np.ndarray, owner: np.ndarray, h: np.ndarray) -> pa.ListArray:
    """The same over a power of two of bits, twice as many as hashes at least, as lists of longs; see ``_apart``."""
    bits = np.maximum(2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), PARITY)
    off = np.concatenate([[0], np.cumsum(bits)])
    at = off[owner] + (mix(h) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(off[-1])).astype(np.uint8) & 1
    return pa.ListArray.from_arrays(pa.array((off // 64).astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view("<i8")))


def _apart(a: str, b: str) -> Column:
    """In how many bits two wide parities differ at least; the longer is folded to the length of the other, half its own."""
    n = F.least(F.size(a), F.size(b))
    of = lambda c, i: F.when(F.size(c) > n, F.get(c, i).bitwiseXOR(F.get(c, i + n))).otherwise(F.get(c, i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.bit_count(of(a, i).bitwiseXOR(of(b, i))))


def _schema(rows: DataFrame, own: tuple[str, ...], more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema] + [more])


def shingle_sets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, id of the set of five-word shingles, and hashes, the set."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__text"):
                n, owner, h = _shingle_sets(s.column("__text"))
                off = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(off), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(_set_ids(n, owner, h)), sets], [*keep, "id", "hashes"])

    return rows.mapInArrow(run, _schema(rows, keep, "id long, hashes array<long>"))


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, how many sampled sets each is in) of the shingles that a sample of texts has most often."""
    every = max(1, docs.count() // SAMPLE_TEXTS)
    sets = shingle_sets(docs.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0), text).dropDuplicates(["id"])
    counts = sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_LEAST)
    got = counts.orderBy(F.desc("n"), "h").limit(COMMON_MOST).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def near_nodes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, id of the set of shingles, its size, parities and fingerprint, and its first shingles, rare ones first."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    known, often = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__text"):
                n, owner, h = _shingle_sets(s.column("__text"))
                size = np.bincount(owner, minlength=n)
                ids, odd, wide = _set_ids(n, owner, h), _parities(n, owner, h), _wide_parities(n, size, owner, h)
                full = np.flatnonzero(size)
                fp = _votes((n, full, size[full], np.cumsum(size[full]), h), 1)[:, 0]
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, often[at], 0)
                    h = h[np.lexsort((h, rank, owner))]
                first = np.cumsum(size) - size
                take = np.arange(len(h)) - first[owner] <= size[owner] // 5
                off = np.concatenate([[0], np.cumsum(np.where(size > 0, size // 5 + 1, 0))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(off), pa.array(h[take].view(np.int64)))
                cols = [pa.array(ids), pa.array(size.astype(np.int32)), pa.array([x.tobytes() for x in odd], pa.binary()), wide, pa.array(fp.view(np.int64)), keys]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), *cols], [*keep, "id", "size", "parity", "wide", "fp", "first"])

    return rows.mapInArrow(run, _schema(rows, keep, "id long, size int, parity binary, wide array<long>, fp long, first array<long>"))


def _surely_apart(differ: np.ndarray) -> np.ndarray:
    """A number of hashes that sets whose parities differ in so many bits hardly ever exceed in being apart.

    Each hash that only one set has turns one of ``PARITY`` bits.  The number of bits turned in the end
    has the mean and variance below; four standard deviations are allowed for.
    """
    most = 0.45 * PARITY
    hashes = lambda bits: -np.log1p(-2 * np.minimum(bits, most) / PARITY) * (PARITY / 2)
    load = hashes(differ) / PARITY
    variance = PARITY * ((1 - np.exp(-4 * load)) / 4 - load * np.exp(-4 * load))
    high = differ + 4 * np.sqrt(np.maximum(variance, 0)) + 1
    return np.where(high < most, hashes(high), np.inf)


def _near_pairs(sure_only: bool):
    """Rows sorted by group (key, low, high) -> (a, b): pairs that may be similar and aren't known to be connected.

    Rows have an id, size and parity, and the root that they are known to belong to.  With
    ``sure_only``, only pairs whose parities leave little doubt, without those that others connect.
    """

    def links(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = len(c["id"])
        by = ("key", "low", "high")
        group = np.cumsum(np.concatenate([[0], np.any([c[k][1:] != c[k][:-1] for k in by], axis=0)])) if n else np.zeros(0, int)
        order = np.lexsort((c["id"], c["size"], group))
        group, ids, size = group[order], c["id"][order], c["size"][order].astype(np.int64)
        odd = np.frombuffer(b"".join(c["parity"][order]), np.uint64).reshape(n, PARITY // 64)
        side, cross = c["tile"][order], (c["low"] != c["high"])[order]
        label = np.unique(c["root"][order], return_inverse=True)[1]
        until = np.searchsorted((group << 32) + size, (group << 32) + size * 5 // 4, "right")  # a similarity of 0.8 needs sizes within 4 : 5
        out = []
        live = np.flatnonzero(until > np.arange(n) + 1)
        lag = 1
        while len(live):
            i, j = live, live + lag
            ok = (~cross[i] | (side[i] != side[j])) & (label[i] != label[j])
            i, j = i[ok], j[ok]
            differ = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)  # no more than the shingles that only one has
            both = size[i] + size[j]
            near = 9 * differ <= both
            i, j, differ, both = i[near], j[near], differ[near], both[near]
            if sure_only:
                sure = _surely_apart(differ) * 9 <= both
                i, j = i[sure], j[sure]
            out.append((ids[i], ids[j]))
            while sure_only and (label[i] != label[j]).any():
                x, y = label[i], label[j]
                to = np.arange(label.max() + 1)
                np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
                label = to[label]
            lag += 1
            live = live[live + lag < until[live]]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return np.minimum(a, b), np.maximum(a, b)

    return _by_group(links, ("key", "low", "high"), ("tile", "id", "size", "parity", "root"), ["a", "b"])


def near_tiles(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """``nodes`` (id, first) by the groups (key, low, high) in which pairs are looked for, see ``near_linked``."""
    keyed = nodes.select(F.explode("first").alias("key"), "id")
    groups = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return checkpointed(_tiled(keyed, groups, ["key"], tile).select("key", "low", "high", "tile", "id"))


def near_pairs(tiles: DataFrame, known: DataFrame, sure_only: bool) -> DataFrame:
    """Pairs (a, b) of ``tiles`` and ``known`` (id, size, parity, root) that may be similar, see ``near_linked``."""
    by = ["key", "low", "high"]
    met = tiles.join(known, "id").select(*by, "tile", "id", "size", "parity", "root")
    pairs = met.repartition(*by).sortWithinPartitions(*by).mapInArrow(_near_pairs(sure_only), "a long, b long")
    return checkpointed(pairs.distinct())


def _some(edges: DataFrame) -> DataFrame:
    """The edges, or where they are many, each node's to the least and the greatest node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = checkpointed(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
    if edges.count() <= 2 * ends.count():
        return edges
    far = ends.select("a", F.explode(F.array("low", "high")).alias("b"))
    return checkpointed(far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_linked(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``nodes`` (id, size, parity, wide, fp, first) of a similarity of 0.8 or more.

    Similarity is the share of common ones among two texts' distinct five-word shingles, by their
    64-bit hashes.  First, sets whose fingerprints ``linked`` connects through pivot tables, which most
    copies are, are joined where their similarity bears it out.  Fingerprints of sets at 0.8 are some
    nine bits apart, though, where no key of agreeing blocks is exact, so the others are found by the
    shingles themselves, and no pair of 0.8 is lost, whatever the number of nodes: with all shingles in
    one order, such a pair shares one of the first size / 5 + 1 of each, sizes are within 4 : 5, and
    parities differ in no more bits than shingles are in one set alone, which is (sum of sizes) / 9
    at most.  Which order is taken decides only the work: common shingles come last.

    Pairs whose parities leave little doubt are verified first, some of them where they are many; then all
    that what is verified doesn't connect, after parities of as many bits as twice their shingles.
    Every edge is verified on the sets themselves, which ``sets`` returns (id, hashes) for a table of ids.
    """

    def verified(edges: DataFrame) -> DataFrame:
        ends = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        known = checkpointed(sets(ends).dropDuplicates(["id"]))
        a, b = (known.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
        common = F.size(F.array_intersect("ha", "hb"))
        out = checkpointed(edges.join(a, "a").join(b, "b").select("a", "b", (9 * common >= 4 * (F.size("ha") + F.size("hb"))).alias("similar")))
        drop(ends, known)
        return out

    def possible(edges: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("id").alias(x), F.col("size").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab")
        return edges.join(a, "a").join(b, "b").where(9 * _apart("wa", "wb") <= F.col("na") + F.col("nb")).select("a", "b")

    fps = checkpointed(nodes.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    of = fps.select("fp", "least")
    a, b = (of.select(F.col("fp").alias(x), F.col("least").alias(f"l{x}")) for x in "ab")
    with workspace(nodes.sparkSession) as work:
        stars = linked(of.select("fp"), tile=tile).join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        stars = work.keep(checkpointed(stars))
    twins = join_small(nodes.select("id", "fp"), fps.where("n > 1").select("fp", "least"), "fp", "inner").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    close = verified(checkpointed(stars.unionByName(twins).distinct())).where("similar").select("a", "b")
    centre = close.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    short = nodes.select("id", "size", "parity")
    known = checkpointed(short.join(centre, "id", "left").withColumn("root", F.coalesce("root", "id")))
    drop(fps, stars)
    release(nodes.sparkSession)
    tiles = near_tiles(nodes, tile)
    sure = near_pairs(tiles, known, True)
    good = close.unionByName(verified(_some(sure)).where("similar").select("a", "b"))
    roots = components(good)
    drop(sure, known)
    known = checkpointed(short.join(roots, short.id == roots.node, "left").select("id", "size", "parity", F.coalesce("root", "id").alias("root")))
    release(nodes.sparkSession)
    pairs = near_pairs(tiles, known, False)
    doubt = checkpointed(possible(pairs))
    drop(roots, known, tiles, pairs)
    return good.unionByName(verified(doubt).where("similar").select("a", "b"))


def classes(docs: DataFrame, d: int = BITS) -> DataFrame:
    """``docs`` (doc_id, fp, ...) with component_id, the least doc_id that a chain of links reaches, and root, the class's fingerprint."""
    own = [c for c in docs.columns if c not in ("component_id", "root")]
    nodes = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked(nodes.select("fp"), d))
    named = nodes.join(roots, nodes.fp == roots.node)
    names = named.groupBy("root").agg(F.min("least").alias("__least"))
    chained = join_small(named, names, "root", "inner").select("fp", "root", "__least")
    single = F.col("root").isNull()
    whole = nodes.join(chained, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(single, F.col("least")).otherwise(F.col("__least")).alias("component_id"))
    return join_small(docs.select(*own), whole, "fp", "inner").select(*own, "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one document of each class of near copies: the least id, then the least text hash.

    Near copies are texts of a similarity of 0.8 or more over distinct five-word shingles (see
    ``near_linked``), and what chains of such pairs connect.

    Only short rows are shuffled; texts meet the list of rows to drop, which is broadcast while it
    is short (``join_small``).  Null ids come last.
    """
    own, most = docs.columns, F.lit((1 << 63) - 1)
    known = F.coalesce(F.col("doc_id").cast("long"), most)
    tagged = docs.withColumns({"__doc": known, "__t": F.xxhash64("text")})
    path = fresh_dir(docs.sparkSession, "near")
    near_nodes(tagged, common_shingles(docs), keep=("__doc", "__t")).write.option("compression", "zstd").parquet(path)
    whole = docs.sparkSession.read.parquet(path)
    nodes = checkpointed(whole.dropDuplicates(["id"]).select("id", "size", "parity", "wide", "fp", "first"))
    rows = checkpointed(whole.select("__doc", "__t", "id"))
    delete(docs.sparkSession, path)

    ones = checkpointed(rows.groupBy("id").agg(F.min(F.struct("__doc", "__t")).alias("one")))

    def sets(ids: DataFrame) -> DataFrame:
        one = ones.join(ids, "id", "left_semi").select("one.*")
        return shingle_sets(join_small(tagged.select("__doc", "__t", "text"), one, ["__doc", "__t"], "left_semi"))

    roots = components(near_linked(nodes, sets))
    rooted = rows.join(roots.withColumnRenamed("node", "id"), "id", "left")
    rooted = checkpointed(rooted.select(F.col("__doc").alias("doc_id"), "__t", F.coalesce("root", "id").alias("root")))
    least = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "__t")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    lose = join_small(rooted, least, "root", "inner").where((F.col("doc_id") != F.col("least.doc_id")) | (F.col("__t") != F.col("least.__t")))
    lose = lose.select(F.col("doc_id").alias("__doc"), "__t").distinct()
    kept = join_small(tagged, lose, ["__doc", "__t"], "left_anti")
    again = checkpointed(rooted.groupBy("doc_id", "__t").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__doc"), "__t"))
    if not again.isEmpty():  # rows that repeat id and text
        once = join_small(kept, again, ["__doc", "__t"], "left_semi").dropDuplicates(["__doc", "__t"])
        kept = join_small(kept, again, ["__doc", "__t"], "left_anti").unionByName(once)
    return kept.select(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = checkpointed(fingerprints(docs, keep=("doc_id",)))
    return classes(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
