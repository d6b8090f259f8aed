"""Encoding and decoding with a merge-type piece model, with seeded merge-dropout.

The model file gives pieces and scores.  A text is cut into chunks that no piece spans (at the
start of each run of spaces, and around line breaks); in each chunk adjacent symbols merge by the
agenda: the candidate with the best score first, the leftmost of equals.  With dropout each
candidate merge is skipped if a keyed hash of (seed, document id, copy, place of the chunk in the
text, position, left, right) says so, with the given probability; a skipped candidate stays off the
agenda until one of its sides changes.  So each occurrence of a word is cut on its own, and
everything is the same in a rerun.

The agenda of a chunk of up to ``LONGEST`` characters is kept as a tree: a node is a state (symbols
and skipped candidates), asks for one draw, that of its best candidate, and leads to one node if the
candidate merges and to another if it is skipped.  All chunks of a slice walk down their trees
together, in numpy, each with its own draws; nodes are made when a walk first reaches them and kept,
up to about ``CACHE_NODES`` of them, so a state is worked out once however many occurrences reach it.
Chunks are told apart by their bytes.  Longer chunks are worked out by a heap, each on its own.

Symbols without a piece become byte pieces.  So does a literal U+2581, the mark that stands for a
space in pieces, which makes decoding lossless for every text.

Defined results: a null or empty text has no ids and decodes to an empty text; null ids draw
alike; repeated rows encode alike unless a copy number tells them apart; an empty table gives an empty one; null in ids decodes as
no ids; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.words import distinct, mix, raw, slices, strings

DROPOUT = 0.1
SEED = 20_240_601
LONGEST = 40
CACHE_NODES = 300_000
SLICE_BYTES = 1 << 20
BLOCK_CHUNKS = 1 << 18
_NONE = (1 << 31) - 1
_SKIPPED = 64
_WIDTHS = ((0, 8), (8, 16), (16, LONGEST))
#: Fixed value: the mark for a space in pieces.
MARK = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """``words.mix`` of one Python integer."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


class Model:
    """Pieces, scores and the table of merges of a model file."""

    SLOT_BITS = 19
    _loaded: dict[str, Model] = {}

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) for i in range(n)]
        self.byte = {int(names[i][1:-1], 16): i for i in range(n) if p.is_byte(i)}
        self.id = {names[i]: i for i in range(n) if not special[i]}
        self.score = np.array([p.get_score(i) for i in range(n)])
        # what each id decodes to
        out = [bytes([int(s[1:-1], 16)]) if p.is_byte(i) else b"" if special[i] else s.replace(MARK, " ").encode() for i, s in enumerate(names)]
        self.text_off = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.text = np.frombuffer(b"".join(out), np.uint8)
        # all ways to put a piece together from two
        keys, to = [], []
        for s, i in self.id.items():
            for k in range(1, len(s)):
                a, b = self.id.get(s[:k]), self.id.get(s[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(i)
        # pieces by score, the best first; equal scores share a place, and -1, no piece, comes last
        self.rank = np.append(np.unique(-self.score, return_inverse=True)[1], _NONE).astype(np.int32)
        order = np.argsort(keys)
        self.pair, self.merged = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order]
        # a table of pairs by slot; pairs that share a slot are looked up by bisection
        slot = self._slot(self.pair)
        self.slot_pair = np.full(1 << self.SLOT_BITS, -1, dtype=np.int64)
        self.slot_merged = np.full(1 << self.SLOT_BITS, -1, dtype=np.int32)
        self.slot_pair[slot], self.slot_merged[slot] = self.pair, self.merged
        self.slot_shared = np.bincount(slot, minlength=1 << self.SLOT_BITS) > 1
        self.table: dict[int, int] | None = None  # the same as a dictionary, once it is needed
        if any("\n" in s or MARK in s.lstrip(MARK) for s in self.id):
            raise ValueError("the model has pieces that span chunks")
        self.char = {s: i for s, i in self.id.items() if len(s) == 1}
        self.plane = -1 - np.arange(1 << 16)
        for c, i in self.char.items():
            if ord(c) < 1 << 16:
                self.plane[ord(c)] = i
        self.plane[0x20], self.plane[ord(MARK)] = self.id[MARK], -1 - ord(MARK)
        self.clear()

    @classmethod
    def at(cls, path: str) -> Model:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def clear(self) -> None:
        """Forgets all nodes."""
        n = 1 << 16
        self.root: dict[bytes, int] = {}  # chunk -> node
        self.nodes = 0
        self.draw = np.zeros(n, dtype=np.uint64)  # what the node's candidate is drawn by
        self.best = np.zeros(n, dtype=np.int8)  # its place, or -1: no candidate is left
        self.to = np.zeros(n, dtype=np.int32)  # what it merges to
        self.next = np.zeros(2 * n, dtype=np.int32)  # node 2 * i merges, 2 * i + 1 skips; -1: not reached yet
        self.first = np.zeros(n, dtype=np.int64)  # the node's symbols, in the two arrays below
        self.size = np.zeros(n, dtype=np.int8)
        self.used = 0
        self.sym = np.zeros(8 * n, dtype=np.int32)
        self.mark = np.zeros(8 * n, dtype=np.int8)  # where each symbol begins, and _SKIPPED if the candidate of it and the next is

    # symbols are vocabulary ids, or -1 - code point where there is no piece

    def symbols(self, text: str) -> np.ndarray:
        """A text's first symbols; spaces count as the mark, a literal mark as a character without a piece."""
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        out = self.plane[np.minimum(point, 0xFFFF)]
        for i in np.flatnonzero(point > 0xFFFF).tolist():
            out[i] = self.char.get(chr(point[i]), -1 - point[i])
        return out

    def expand(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out += [self.byte[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")]
        return out

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * _STEP) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's merge, or -1."""
        key = left.astype(np.int64) << 32 | right  # negative symbols give keys that no pair has
        slot = self._slot(key)
        out = np.where(self.slot_pair[slot] == key, self.slot_merged[slot], -1)
        rare = np.flatnonzero(self.slot_shared[slot] & (out < 0))
        if len(rare):
            at = np.minimum(np.searchsorted(self.pair, key[rare]), len(self.pair) - 1)
            out[rare] = np.where(self.pair[at] == key[rare], self.merged[at], -1)
        return out

    def by_heap(self, symbols: list[int], key: int, limit: int) -> list[int]:
        """The agenda over one chunk with a heap."""
        n = len(symbols)
        sym, nxt, prv, heap = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), []
        if self.table is None:
            self.table = dict(zip(self.pair.tolist(), self.merged.tolist(), strict=True))
        table = self.table

        def push(a: int, b: int) -> None:
            if a < 0 or b >= n or sym[a] < 0 or sym[b] < 0:
                return
            to = table.get(sym[a] << 32 | sym[b])
            if to is not None and _mix(key ^ _mix((sym[a] << 32 | sym[b]) + a * 0x9E3779B97F4A7C15 & _MASK)) >= limit:
                heapq.heappush(heap, (-self.score[to], a, sym[a], sym[b], to))

        for a in range(n - 1):
            push(a, a + 1)
        gone = [False] * n
        while heap:
            _, a, x, y, to = heapq.heappop(heap)
            b = nxt[a]
            if gone[a] or b >= n or sym[a] != x or sym[b] != y:
                continue
            sym[a], gone[b], nxt[a] = to, True, nxt[b]
            if nxt[b] < n:
                prv[nxt[b]] = a
            push(prv[a], a)
            push(a, nxt[a])
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    # trees of states

    def _new(self, sym: np.ndarray, mark: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Nodes for states, a row each, padded to one width."""
        n, width = sym.shape
        inside = np.arange(width) < size[:, None]
        rank = np.full((n, width), _NONE, dtype=np.int32)
        at = np.flatnonzero(inside[:, 1:] & (mark[:, :-1] < _SKIPPED))
        at += at // (width - 1) if width > 1 else 0
        flat = sym.ravel()
        rank.ravel()[at] = self.rank[self.merge(flat[at], flat[at + 1])]
        rows, best = np.arange(n), rank.argmin(axis=1)
        some = rank[rows, best] < _NONE
        left, right = sym[rows, best].astype(np.int64), sym[rows, np.minimum(best + 1, width - 1)]
        total = int(size.sum())
        self._room(self.nodes + n, self.used + total)
        a, z = self.nodes, self.nodes + n
        self.draw[a:z] = mix((left << 32 | right).astype(np.uint64) + (mark[rows, best] & (_SKIPPED - 1)).astype(np.uint64) * _STEP)
        self.best[a:z] = np.where(some, best, -1)
        self.to[a:z] = self.merge(left, right)
        self.next[2 * a : 2 * z] = -1
        self.size[a:z] = size
        self.first[a:z] = self.used + np.cumsum(size) - size
        for kept, x in ((self.sym, sym), (self.mark, mark)):
            kept[self.used : self.used + total] = x[inside]
        self.nodes, self.used = z, self.used + total
        return np.arange(a, z)

    def _room(self, nodes: int, symbols: int) -> None:
        for names, need, per in ((("draw", "best", "to", "first", "size"), nodes, 1), (("next",), nodes, 2), (("sym", "mark"), symbols, 1)):
            for name in names:
                x = getattr(self, name)
                if len(x) < need * per:
                    setattr(self, name, np.concatenate([x, np.zeros(max(len(x) // 2, need * per - len(x)), dtype=x.dtype)]))

    def _after(self, node: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """New nodes: what ``node`` leads to if its candidate merges, or where ``skip``, is skipped."""
        out = np.zeros(len(node), dtype=np.int64)
        sizes = self.size[node].astype(np.int64)
        for low, high in _WIDTHS:
            part = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(part), 16384):
                at = part[k : k + 16384]
                size, skipped, who = sizes[at], skip[at], node[at]
                cols, rows = np.arange(size.max()), np.arange(len(at))
                where = np.minimum(self.first[who][:, None] + cols, self.used - 1)
                sym, mark = self.sym[where], self.mark[where]
                best = self.best[who].astype(np.int64)
                mark[rows[skipped], best[skipped]] |= _SKIPPED
                met = np.flatnonzero(~skipped)
                sym[met, best[met]] = self.to[who[met]]
                left = met[best[met] > 0]
                mark[left, best[left] - 1] &= _SKIPPED - 1
                after = ~skipped[:, None] & (cols[:-1] > best[:, None])  # columns that take over their right neighbour
                for x in (sym, mark):
                    np.copyto(x[:, :-1], x[:, 1:].copy(), where=after)
                out[at] = self._new(sym, mark, size - ~skipped)
        return out

    def _roots(self, chunks: list[bytes]) -> np.ndarray:
        """The node that each chunk begins at."""
        missing = [c for c in chunks if c not in self.root]
        if missing:
            text = [c.decode() for c in missing]
            size = np.fromiter(map(len, text), np.int64, len(text))
            flat = self.symbols("".join(text))
            first = np.cumsum(size) - size
            for low, high in _WIDTHS:
                part = np.flatnonzero((size > low) & (size <= high))
                for k in range(0, len(part), 16384):
                    at = part[k : k + 16384]
                    cols = np.arange(size[at].max())
                    sym = flat[np.minimum(first[at][:, None] + cols, len(flat) - 1)]
                    nodes = self._new(sym, np.broadcast_to(cols.astype(np.int8), sym.shape), size[at])
                    self.root.update(zip([missing[i] for i in at.tolist()], nodes.tolist(), strict=True))
        return np.fromiter(map(self.root.__getitem__, chunks), np.int64, len(chunks))

    def _walk(self, node: np.ndarray, own: np.ndarray, limit: int) -> np.ndarray:
        """The node without candidates that each chunk, drawing by ``own``, comes to from ``node``."""
        node, live = node.copy(), np.arange(len(node))
        while True:
            live = live[self.best[node[live]] >= 0]
            if not len(live):
                return node
            now = node[live]
            skip = mix(own[live] ^ self.draw[now]) < np.uint64(limit)
            edge = 2 * now + skip
            to = self.next[edge].astype(np.int64)
            missing = np.flatnonzero(to < 0)
            if len(missing):
                u, back = np.unique(edge[missing], return_inverse=True)
                new = self._after(u >> 1, (u & 1).astype(bool))
                self.next[u] = new
                to[missing] = new[back]
            node[live] = to

    def encode(self, column: pa.Array, drawn: np.ndarray, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, whose keys are ``drawn``, in a row, and where each text's begin and end in it."""
        data, off = raw(strings(column))
        limit = min(int(dropout * 2.0**64), _MASK)
        full = np.flatnonzero(np.diff(off) > 0)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        text = np.insert(data, off[full], 0x20)  # the space that stands before every text
        first = off[full] + np.arange(len(full))
        before = np.concatenate([[0x0A], text[:-1]])
        begins = (text == 0x20) & (before != 0x20) | (text == 0x0A) != (before == 0x0A)
        begins[first] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(text))
        of = np.searchsorted(first, start, "right") - 1
        own = mix(drawn[full][of] ^ mix((start - first[of]).astype(np.uint64)))
        got = [self._block(text, start[k : k + BLOCK_CHUNKS], end[k : k + BLOCK_CHUNKS], own[k : k + BLOCK_CHUNKS], limit) for k in range(0, len(start), BLOCK_CHUNKS)]
        ids, size = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        edge = np.concatenate([[0], np.cumsum(size)])[np.append(np.searchsorted(start, first), len(start))]
        at = np.zeros(len(off), dtype=np.int64)
        at[full + 1] = np.diff(edge)
        return ids, np.cumsum(at)

    def _block(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some chunks in a row, and how many each has."""
        if self.nodes > CACHE_NODES:
            self.clear()
        chars = np.concatenate([[0], np.cumsum((text[start[0] : end[-1]] & 0xC0) != 0x80)])
        short = chars[end - start[0]] - chars[start - start[0]] <= LONGEST
        number, values = distinct(text, start, end)
        used = np.unique(number[short])
        root = np.zeros(len(values), dtype=np.int64)
        root[used] = self._roots(values.take(pa.array(used)).to_pylist())
        leaf = self._walk(root[number[short]], own[short], limit)
        size = np.zeros(len(start), dtype=np.int64)
        size[short] = n = self.size[leaf]
        flat = self.sym[_spans(self.first[leaf], n.astype(np.int64))]
        odd = np.flatnonzero(flat < 0)
        if len(odd):  # characters without a piece
            rows = [self.expand([x]) for x in flat[odd].tolist()]
            more = np.fromiter(map(len, rows), np.int64, len(rows))
            size[short] += np.bincount(np.repeat(np.arange(len(n)), n)[odd], more - 1, minlength=len(n)).astype(np.int64)
            width = np.ones(len(flat), dtype=np.int64)
            width[odd] = more
            flat = np.repeat(flat, width)
            flat[_spans((np.cumsum(width) - width)[odd], more)] = [x for row in rows for x in row]
        long = {}
        for i in np.flatnonzero(~short).tolist():
            symbols = self.symbols(text[start[i] : end[i]].tobytes().decode())
            long[i] = self.expand(self.by_heap(symbols.tolist(), int(own[i]), limit))
            size[i] = len(long[i])
        if not long:
            return flat, size
        stop = np.cumsum(size)
        out = np.zeros(int(stop[-1]), dtype=np.int32)
        out[_spans((stop - size)[short], size[short])] = flat
        for i, ids in long.items():
            out[stop[i] - size[i] : stop[i]] = ids
        return out, size

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The texts of ids[off[i]:off[i + 1]]."""
        size = self.text_off[ids + 1] - self.text_off[ids]
        stop = np.cumsum(size)
        flat = self.text[np.repeat(self.text_off[ids] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        edge = np.concatenate([[0], stop])[off].tolist()
        return [flat[a + 1 : z] if z > a else b"" for a, z in zip(edge[:-1], edge[1:], strict=True)]  # without the space before


def keys(ids: np.ndarray, known: np.ndarray, copies: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Each document's key for its draws."""
    own = np.where(known, mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)), np.uint64(0))
    return mix(mix(own ^ np.uint64(seed & _MASK)) + mix(copies.astype(np.int64).view(np.uint64)))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start..start + size - 1 of each, in a row."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


def _schema(df: DataFrame, own: list[str], more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema] + [more])


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] | None = None, seed: int = SEED, dropout: float = DROPOUT, copy: str | None = None) -> DataFrame:
    """``keep`` columns (all, by default) and ids; ``copy`` is the column that numbers a document's copies."""
    own = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    rows = docs.select(*own, F.col(text).cast("string").alias("__text"), F.col("doc_id").cast("long").alias("__id"), (F.lit(0) if copy is None else F.col(copy)).cast("long").alias("__copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.at(model)
        for b in batches:
            for s in slices(b, "__text", SLICE_BYTES):
                key = s.column("__id")
                drawn = keys(key.fill_null(0).to_numpy(), np.asarray(key.is_valid()), s.column("__copy").to_numpy(), seed)
                ids, off = m.encode(s.column("__text"), drawn, dropout)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), lists], [*own, "ids"])

    return rows.mapInArrow(run, _schema(rows, own, "ids array<int>"))


def decode(tokens: DataFrame, model: str, column: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all but the ids, by default) and text, n_tokens and ids_crc32 of the ids."""
    new = ("text", "n_tokens", "ids_crc32")
    own = [c for c in (tokens.columns if keep is None else keep) if c not in new and (keep is not None or c != column)]
    rows = tokens.select(*own, F.coalesce(F.col(column).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.at(model)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                lists = s.column("__ids")
                off = np.asarray(lists.offsets).astype(np.int64)
                ids = np.asarray(lists.flatten())
                off -= off[0]
                data = ids.astype("<u4").tobytes()
                edge = (4 * off).tolist()
                crc = [zlib.crc32(data[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)]
                texts = pa.array(m.decode(ids, off), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), texts, pa.array(np.diff(off)), pa.array(crc, pa.int64())], [*own, *new])

    return rows.mapInArrow(run, _schema(rows, own, "text string, n_tokens long, ids_crc32 long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = decode(encode(docs, model, keep=("doc_id",)), model)
    return back.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
