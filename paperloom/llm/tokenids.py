"""Token ids in word-aligned Simple-8b files.

Each 64-bit word has a 4-bit selector and 60 bits of payload; the selector says how many ids of
which width the word holds.  An id that is too wide for 20 bits is written as an escape (a slot
of twenty ones) and stored whole in the block's escape list.  Ids are cut into blocks of
``BLOCK`` ids; every block starts at a word, and the file keeps each block's first word and first
escape, so blocks are packed and unpacked independently, here all at once in numpy.

File: header, document ids, tokens per document, block offsets, words, escapes, footer.  The
header holds the file's place in the order of all files and its number of ids, so that reading
the headers gives the number of ids before each file.

Documents are ordered by range partitioning on (doc_id, text hash), so no partition outgrows its
share and equal ids are no problem.

Defined results: a null text is an empty one (the end id alone); null ids come first; repeated
rows are encoded each; an empty table writes no file and returns no row; further columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import fresh_dir, read_blobs, write_blobs
from paperloom.llm.words import distinct, raw, slices, strings

#: Fixed values of the format: (ids, bits) by selector, the escape slot, magic and footer.
SHAPES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20))
ESCAPE_BITS = 20
ESCAPE = (1 << ESCAPE_BITS) - 1
MAGIC = b"S8B-IDS1"
FOOTER = "S8B-END1"
HEADER = struct.Struct(">8sqqqqqq")  # magic, place, ids, documents, ids in a block, words, escapes

BLOCK = 1024
FILE_IDS = 1 << 23
PIECE_IDS = 1 << 20  # packed and unpacked at once
END_ID = 2
CACHE_PIECES = 200_000
SLICE_BYTES = 2 << 20


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids (uint32) as (words, first word by block, escapes, first escape by block)."""
    n = len(ids)
    blocks = -(-n // block)
    wide = 60
    values = np.zeros((blocks, block + wide), dtype=np.uint64)
    flat = np.zeros(blocks * block, dtype=np.uint64)
    flat[:n] = ids
    escaped = flat >= ESCAPE
    values[:, :block] = np.where(escaped, np.uint64(ESCAPE), flat).reshape(blocks, block)
    escapes = flat[escaped].astype(np.uint32)
    first_escape = np.concatenate([[0], np.cumsum(escaped.reshape(blocks, block).sum(axis=1))]).astype(np.uint32)
    bits = np.zeros(values.shape, dtype=np.uint8)
    for b in range(ESCAPE_BITS):
        bits += values >= np.uint64(1 << b)
    best = np.full((blocks, block), len(SHAPES) - 1, dtype=np.int8)
    maxima = {1: bits}
    for p in (1, 2, 4, 8, 16):
        m = maxima[p]
        maxima[2 * p] = np.maximum(m[:, : m.shape[1] - p], m[:, p:])
    for s in range(len(SHAPES) - 1, -1, -1):
        k, width = SHAPES[s]
        p = 1 << (k.bit_length() - 1)
        m = maxima[p]
        fits = np.maximum(m[:, :block], m[:, k - p : k - p + block]) <= width
        best[fits] = s
    counts = np.array([k for k, _ in SHAPES], dtype=np.int64)
    size = np.full(blocks, block, dtype=np.int64)
    if blocks:
        size[-1] = n - (blocks - 1) * block
    at = np.zeros(blocks, dtype=np.int64)
    live = np.arange(blocks)
    steps = []
    while len(live):
        s = best[live, at[live]]
        steps.append((live, at[live].copy(), s))
        at[live] += counts[s]
        live = live[at[live] < size[live]]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), escapes, first_escape
    owner, start, shape = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(owner * (block + 1) + start, kind="stable")
    owner, start, shape = owner[order], start[order], shape[order]
    words = shape.astype(np.uint64) << np.uint64(60)
    for s, (k, width) in enumerate(SHAPES):
        at = np.flatnonzero(shape == s)
        if len(at):
            got = values[owner[at][:, None], start[at][:, None] + np.arange(k)]
            words[at] |= np.bitwise_or.reduce(got << (np.arange(k) * width).astype(np.uint64), axis=1)
    first_word = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))]).astype(np.uint32)
    return words, first_word, escapes, first_escape


def unpack(words: np.ndarray, first_word: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids that ``pack`` packed."""
    counts = np.array([k for k, _ in SHAPES], dtype=np.int64)
    shape = (words >> np.uint64(60)).astype(np.int64)
    k = counts[shape]
    before = np.cumsum(k) - k
    owner = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word.astype(np.int64)))
    start = before - before[first_word[:-1].astype(np.int64)][owner] + owner * block if len(words) else before
    stop = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, dtype=np.uint32)
    for s, (c, width) in enumerate(SHAPES):
        at = np.flatnonzero(shape == s)
        if len(at):
            got = (words[at][:, None] >> (np.arange(c) * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
            to = start[at][:, None] + np.arange(c)
            inside = to < stop[at][:, None]
            out[to[inside]] = got[inside]
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


def pack_pieces(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``pack``, some blocks after the others, so that its memory doesn't grow with the file."""
    step = max(1, PIECE_IDS // block) * block
    parts = [pack(ids[k : k + step], block) for k in range(0, max(len(ids), 1), step)]
    words, first_word, escapes, first_escape = zip(*parts, strict=True)

    def offsets(firsts) -> np.ndarray:
        base = np.cumsum([0, *(int(f[-1]) for f in firsts)])
        return np.concatenate([[0], *(f[1:] + b for f, b in zip(firsts, base[:-1], strict=True))]).astype(np.uint32)

    return np.concatenate(words), offsets(first_word), np.concatenate(escapes), offsets(first_escape)


def unpack_pieces(words: np.ndarray, first_word: np.ndarray, escapes: np.ndarray, first_escape: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids that ``pack_pieces`` packed."""
    out, step = np.zeros(n, dtype=np.uint32), max(1, PIECE_IDS // block)
    for k in range(0, len(first_word) - 1, step):
        z = min(k + step, len(first_word) - 1)
        a, stop = k * block, min(z * block, n)
        out[a:stop] = unpack(words[first_word[k] : first_word[z]], first_word[k : z + 1] - first_word[k], escapes[first_escape[k] : first_escape[z]], stop - a, block)
    return out


def to_file(place: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One file without its footer."""
    words, first_word, escapes, first_escape = pack_pieces(ids, block)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    keys = np.array([x or 0 for x in doc_ids], dtype="<i8")
    head = HEADER.pack(MAGIC, place, len(ids), len(doc_ids), block, len(words), len(escapes))
    parts = (known, keys, lengths.astype("<u4"), first_word.astype("<u4"), first_escape.astype("<u4"), words.astype("<u8"), escapes.astype("<u4"))
    return b"".join([head, *(x.tobytes() for x in parts)])


def from_file(data: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(place, document ids, ids per document, ids) of a file."""
    magic, place, n, docs, block, n_words, n_escapes = HEADER.unpack_from(data)
    if magic != MAGIC or not data.endswith(FOOTER.encode()):
        raise ValueError("not a whole file of packed ids")
    blocks, at, got = -(-n // block), HEADER.size, []
    for kind, size in (("<u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", blocks + 1), ("<u4", blocks + 1), ("<u8", n_words), ("<u4", n_escapes)):
        got.append(np.frombuffer(data, kind, size, at))
        at += got[-1].nbytes
    known, keys, lengths, first_word, first_escape, words, escapes = got
    return place, [int(k) if y else None for y, k in zip(known, keys, strict=True)], lengths, unpack_pieces(words, first_word, escapes, first_escape, n, block)


#: Byte classes of plain texts: letters (also U+00C0-U+024F), digits, white space, others.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[*range(0x09, 0x0E), 0x20]] = 3
#: Bytes that make a text odd: apostrophes (contractions), rarer white space, characters beyond U+024F.
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(0x1C, 0x20), 0x27, 0xC2, *range(0xCA, 0x100)]] = True



def _alphabet() -> dict[int, int]:
    """Byte -> character of the byte-level vocabulary: printable Latin-1 stands for itself, others follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(rest)}


_ALPHABET = _alphabet()
_loaded: dict[str, Encoder] = {}


class Encoder:
    """The vocabulary file's encoder.

    Byte-level pieces are encoded independently of each other.  In plain texts the pieces are cut
    by byte classes, all at once; the ids of the last ``CACHE_PIECES`` pieces at least are kept, and
    only new pieces go to the encoder.  Texts with apostrophes, rarer characters or
    the vocabulary's special token go to it whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.kept: dict[bytes, bytes] = {}  # piece -> its ids, little-endian
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, each as bytes."""
        if len(self.kept) > CACHE_PIECES:
            self.kept, self.older = {}, self.kept
        kept, older, encode = self.kept, self.older, self.whole.model.tokenize  # a piece needs no further splitting
        out = list(map(kept.get, pieces))
        for i, ids in enumerate(out):
            if ids is None:
                p = pieces[i]
                ids = older.get(p)
                if ids is None:
                    got = [t.id for t in encode(p.decode("latin1").translate(_ALPHABET))]
                    ids = struct.pack(f"<{len(got)}I", *got)
                kept[p] = out[i] = ids
        return out

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts without empty ones, and how many each has."""
        kind = _CLASS[data]
        first = np.zeros(len(data), dtype=bool)
        first[off[:-1]] = True
        new = first.copy()
        new[1:] |= kind[1:] != kind[:-1]
        space, last = kind == 3, np.zeros(len(data), dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:]  # the last white space before a word
        begins = new & space | last
        joined = np.zeros(len(data), dtype=bool)
        joined[1:] = (data[:-1] == 0x20) & ~first[1:]
        begins |= new & ~space & ~joined
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        number, values = distinct(data, start, end)
        found = self._ids_of(values.to_pylist())
        of = np.fromiter(map(len, found), np.int64, len(found)) // 4
        size, first = of[number], (np.cumsum(of) - of)[number]
        stop = np.cumsum(size)
        out = np.frombuffer(b"".join(found), "<u4")[np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        edge = np.concatenate([[0], stop])[np.searchsorted(start, off)]
        return out, np.diff(edge)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        data, off = raw(strings(column))
        n = len(off) - 1
        out = [np.zeros(0, dtype=np.uint32)] * n
        wrong = np.concatenate([[0], np.cumsum(_ODD[data])])
        odd = wrong[off[1:]] > wrong[off[:-1]]
        if len(data):
            sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
            odd[np.searchsorted(off, sign, "right") - 1] = True
            for s in self.special:
                whole, at = data.tobytes(), -1
                while (at := whole.find(s, at + 1)) >= 0:
                    odd[np.searchsorted(off, at, "right") - 1] = True
        size = np.diff(off)
        plain = np.flatnonzero(~odd & (size > 0))
        if len(plain):
            keep = np.repeat(~odd, size)
            inner = np.concatenate([[0], np.cumsum(size[plain])])
            ids, count = self._plain(data[keep], inner)
            stop = np.cumsum(count)
            for i, a, z in zip(plain.tolist(), (stop - count).tolist(), stop.tolist(), strict=True):
                out[i] = ids[a:z]
        rest = np.flatnonzero(odd).tolist()
        whole = [data[off[i] : off[i + 1]].tobytes().decode() for i in rest]
        for i, got in zip(rest, self._encode(whole) if rest else [], strict=True):
            out[i] = np.array(got, dtype=np.uint32)
        return out


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, file_ids: int = FILE_IDS) -> None:
    """Encodes ``docs`` (doc_id, text) in ascending order of doc_id and writes the ids' files to ``path``."""
    end = np.array([] if end_id is None else [end_id], dtype=np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.at(vocabulary), TaskContext.get().partitionId()
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        n = files = 0

        def done() -> pa.RecordBatch:
            data = to_file(part << 32 | files, keys, np.array([len(x) for x in held]), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])

        for b in batches:
            for piece in slices(b, "text", SLICE_BYTES):
                keys += piece.column("doc_id").to_pylist()
                new = [np.concatenate([x, end]) for x in encoder.encode(piece.column("text"))]
                held += new
                n += sum(map(len, new))
                if n >= file_ids:
                    yield done()
                    keys, held, n, files = [], [], 0, files + 1
        if held:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    write_blobs(ordered.mapInArrow(encode, "file binary"), "file", path, FOOTER)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, start counted over all files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                place, keys, lengths, flat = from_file(content.as_buffer().to_pybytes())
                off = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                data = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(off[:-1], off[1:], strict=True)]
                cols = [pa.array(np.full(len(keys), place)), pa.array(keys, pa.int64()), pa.array(off[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["place", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    files = read_blobs(spark, path)
    number = lambda k: F.conv(F.hex(F.substring("content", 9 + 8 * k, 8)), 16, 10).cast("long")
    heads = files.select(number(0).alias("place"), number(1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("place", before.alias("before"))  # one row per file
    schema = "place long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    rows = files.select("content").mapInArrow(decode, schema)
    return rows.join(heads, "place").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_dir(spark, "ids")
    write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path, ids=False)
