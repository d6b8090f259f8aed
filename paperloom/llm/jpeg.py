"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, then inverse transform.

``decode`` reads spectral-selection and successive-approximation scans of one or three
components with any sampling factors, Huffman tables and restart intervals, adds them up in
arrays of coefficients, transforms these blocks back all at once, upsamples chroma and returns a
full-resolution RGB tensor with the coefficients.

``encode_payload`` stores bytes losslessly in the format's own unit, the quantised coefficient,
with 64 to a block.  A byte b is the coefficient b if b >= 128 and b - 255 otherwise, so each has
eight magnitude bits and none is zero.  The image has 4:2:0 sampling; blocks beyond the payload
hold zero bytes; an application segment keeps the payload's length.  Scans: DC without its last
bit, two bands of AC without theirs, then the last bits of DC and of AC.  All code lengths are
chosen so that every first-pass symbol with its bits is 16 bits long, which lets numpy cut a scan
into symbols without walking it; tables like that are recognised on reading, others are walked.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: The zigzag order of a block's coefficients, as rows of its 8 x 8 square.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Markers.
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, APP9 = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xE9
TAG = b"payload\0"
BANDS = ((1, 5), (6, 63))

_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_k = np.arange(8)
_COS = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)
_COS = _COS.astype(np.float32)  # pixel, frequency


def _bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """A row of 0 and 1: each value in its number of bits, highest first."""
    most = int(widths.max(initial=0))
    all_bits = (values[:, None] >> np.arange(most - 1, -1, -1)) & 1
    return all_bits[np.arange(most - 1, -1, -1) < widths[:, None]].astype(np.uint8)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of magnitude bits, those bits) of signed values."""
    size = np.zeros(len(v), dtype=np.int64)
    a = np.abs(v)
    for b in range(12):
        size += a >= (1 << b)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _scan_bytes(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: padded with ones, 0xFF followed by a zero byte."""
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)])).tobytes().replace(b"\xff", b"\xff\0")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbols: dict[int, int]) -> bytes:
    """A Huffman table segment from symbol -> code length; codes ascend by length."""
    order = sorted(symbols, key=lambda s: (symbols[s], s))
    counts = [sum(symbols[s] == n for s in order) for n in range(1, 17)]
    return _segment(DHT, bytes([kind << 4 | slot, *counts, *order]))


#: The writer's code lengths: with its extra bits every symbol has 16 bits.
_DC_LENGTHS = {size: 16 - size for size in range(10)}
_AC_LENGTHS = {7: 9, 0: 16, **{r << 4: 16 for r in range(1, 15)}}


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a table."""
    out, code, at = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for s in symbols[at : at + c]:
            out[s] = (code, n)
            code += 1
        at += c
        code <<= 1
    return out


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return codes([sum(lengths[s] == n for s in order) for n in range(1, 17)], order)


_DC_CODES, _AC_CODES = _canonical(_DC_LENGTHS), _canonical(_AC_LENGTHS)
_DC_WORD = np.array([_DC_CODES[s][0] << s for s in range(10)])


def grid(blocks: int) -> tuple[int, int]:
    """(columns, rows) of 16 x 16 pixel units, six blocks each, for so many blocks."""
    units = max(1, -(-blocks // 6))
    columns = min(4095, int(np.ceil(np.sqrt(units))))
    rows = -(-units // columns)
    if rows > 4095:
        raise ValueError("payload too long for one image")
    return columns, rows


def _planes(columns: int, rows: int) -> list[np.ndarray]:
    """Block numbers of each component, in the order of its blocks by rows."""
    n = columns * rows
    return [np.arange(4 * n), np.arange(4 * n, 5 * n), np.arange(5 * n, 6 * n)]


_HEAD = b"\xff\xd8"
_DQT = _segment(DQT, bytes([0] + [1] * 64))
_TABLES = _table(0, 0, _DC_LENGTHS) + _table(1, 0, _AC_LENGTHS)


def _sos(components: list[int], band: tuple[int, int], high: int, low: int) -> bytes:
    body = bytes([len(components), *(x for c in components for x in (c, 0)), *band, high << 4 | low])
    return _segment(SOS, body)


def _interleaved(columns: int, rows: int) -> np.ndarray:
    """Block numbers in the order of an interleaved scan: four luma blocks, then one of each chroma."""
    n = columns * rows
    y, x = np.divmod(np.arange(n), columns)
    luma = [(2 * y + dy) * (2 * columns) + 2 * x + dx for dy in (0, 1) for dx in (0, 1)]
    return np.column_stack([*luma, 4 * n + np.arange(n), 5 * n + np.arange(n)]).ravel()


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload`` (a positive multiple of 64 bytes)."""
    if not payload or len(payload) % 64:
        raise ValueError("the payload is no positive multiple of 64 bytes")
    used = len(payload) // 64
    columns, rows = grid(used)
    total = 6 * columns * rows
    data = np.zeros(total * 64, dtype=np.int32)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(total, 64)  # in zigzag order
    coded = np.where(data >= 128, data, data - 255)
    out = [_HEAD, _segment(APP9, TAG + struct.pack(">Q", len(payload))), _DQT]
    out.append(_segment(SOF2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_TABLES)

    order = _interleaved(columns, rows)
    dc = coded[:, 0] >> 1
    by_unit = dc[order].reshape(-1, 6)
    diff = np.empty_like(by_unit)
    luma = by_unit[:, :4].ravel()
    diff[:, :4] = np.diff(luma, prepend=0).reshape(-1, 4)
    diff[:, 4:] = np.diff(by_unit[:, 4:], axis=0, prepend=np.zeros((1, 2), by_unit.dtype))
    size, extra = _magnitude(diff.ravel())
    word = (_DC_WORD[size] | extra).astype(">u2")
    out += [_sos([1, 2, 3], (0, 0), 0, 1), word.tobytes().replace(b"\xff", b"\xff\0")]

    # |v| >> 1 has seven bits: as magnitude bits they are the byte's upper bits without the highest, or their mirror
    low = np.abs(coded) >> 1
    first = np.where(coded < 0, 127 - low, low).astype(np.uint8)
    ac = np.zeros((total, 64, 2), dtype=np.uint8)
    ac[:, :, 0] = _AC_CODES[7][0] >> 1
    ac[:, :, 1] = first | (_AC_CODES[7][0] & 1) << 7
    planes = _planes(columns, rows)
    for c, blocks in enumerate(planes, 1):
        for a, z in BANDS:
            out += [_sos([c], (a, z), 0, 1), ac[blocks[0] : blocks[-1] + 1, a : z + 1].tobytes().replace(b"\xff", b"\xff\0")]
    out += [_sos([1, 2, 3], (0, 0), 1, 0), _scan_bytes((coded[order, 0] & 1).astype(np.uint8))]
    last = (np.abs(coded[:, 1:]) & 1).astype(np.uint8)
    for c, blocks in enumerate(planes, 1):
        bits, at = [], 0
        while at < len(blocks):  # runs of blocks without new coefficients: all bits are corrections
            power = min(14, (len(blocks) - at).bit_length() - 1)
            run = 1 << power
            code, length = _AC_CODES[power << 4]
            bits.append(_bits(np.array([code, 0]), np.array([length, power])))
            bits.append(last[blocks[at] : blocks[at] + run].ravel())
            at += run
        out += [_sos([c], (1, 63), 1, 0), _scan_bytes(np.concatenate(bits))]
    out.append(b"\xff\xd9")
    return b"".join(out)


class Table:
    """A Huffman table: its codes, and how to cut its scans if all symbols with their bits have 16 bits."""

    _kept: dict[bytes, "Table"] = {}

    def __init__(self, counts: list[int], symbols: list[int]):
        self.lookup = {(length, code): s for s, (code, length) in codes(counts, symbols).items()}
        self.even = all(length + (s & 15) == 16 for (length, _), s in self.lookup.items() if s < 16)
        #: For the one symbol of 16 bits without a run, if it is the only one: (size, code).
        plain = [(s, code) for (length, code), s in self.lookup.items() if 0 < s < 16 and length + s == 16]
        self.plain = plain[0] if len(plain) == 1 else None
        self.values: np.ndarray | None = None

    @classmethod
    def of(cls, body: bytes) -> "Table":
        got = cls._kept.get(body)
        if got is None:
            counts = list(body[:16])
            got = cls(counts, list(body[16 : 16 + sum(counts)]))
            if len(cls._kept) < 64:
                cls._kept[body] = got
        return got

    def even_values(self, word: np.ndarray) -> np.ndarray:
        """Signed values of 16-bit symbols, magnitude bits included."""
        if self.values is None:
            self.values = np.zeros(1 << 16, dtype=np.int32)
            for (_, code), size in self.lookup.items():
                if size < 16:
                    v = np.arange(1 << size)
                    self.values[(code << size) + v] = np.where(v >> max(size - 1, 0), v, v - (1 << size) + 1) if size else 0
        return self.values[word]


class _Reader:
    """Bits of one stretch between restart markers."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def get(self, n: int) -> int:
        x, got = 0, self.bits[self.at : self.at + n].tolist()
        for b in got:
            x = x << 1 | b
        self.at += n
        return x << (n - len(got))

    def symbol(self, table: Table) -> int:
        code = 0
        for n, b in enumerate(self.bits[self.at : self.at + 16].tolist(), 1):
            code = code << 1 | b
            s = table.lookup.get((n, code))
            if s is not None:
                self.at += n
                return s
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        x = self.get(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


class Decoder:
    """Accumulates the scans of one image."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], Table] = {}
        self.restart = 0
        self.tag: bytes | None = None
        self.components: list[dict] = []
        self._parse(data)

    def _parse(self, data: bytes) -> None:
        if data[:2] != _HEAD:
            raise ValueError("not a JPEG")
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            marker = data[at + 1]
            if marker == EOI:
                return
            (n,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == APP9 and body.startswith(TAG):
                self.tag = body[len(TAG) :]
            elif marker == DQT:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == DHT:
                while body:
                    n = 17 + sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = Table.of(body[1:n])
                    body = body[n:]
            elif marker == DRI:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == SOF2:
                self._frame(body)
            elif marker == SOS:
                end = _MARKER.search(data, at).start()
                self._scan(body, data[at:end])
                at = end
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a progressive Huffman JPEG")

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        for i in range(n):
            ident, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.components.append({"id": ident, "h": hv >> 4, "v": hv & 15, "q": q})
        self.h, self.v = max(c["h"] for c in self.components), max(c["v"] for c in self.components)
        self.columns, self.rows = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c["across"], c["down"] = self.columns * c["h"], self.rows * c["v"]
            c["own"] = (-(-(-(-self.width * c["h"] // self.h)) // 8), -(-(-(-self.height * c["v"] // self.v)) // 8))
            c["blocks"] = np.zeros((c["across"] * c["down"], 64), dtype=np.int32)

    def _order(self, parts: list[dict]) -> tuple[list[tuple[dict, np.ndarray]], int]:
        """For each block of a unit of the scan, its component and its number in every unit; and the number of units."""
        if len(parts) == 1:
            c = parts[0]
            y, x = np.divmod(np.arange(c["own"][0] * c["own"][1]), c["own"][0])
            return [(c, y * c["across"] + x)], len(y)
        y, x = np.divmod(np.arange(self.columns * self.rows), self.columns)
        return [(c, (y * c["v"] + dy) * c["across"] + x * c["h"] + dx) for c in parts for dy in range(c["v"]) for dx in range(c["h"])], len(y)

    def _scan(self, head: bytes, coded: bytes) -> None:
        n = head[0]
        parts, dc, ac = [], [], []
        for i in range(n):
            ident, slots = head[1 + 2 * i], head[2 + 2 * i]
            parts.append(next(c for c in self.components if c["id"] == ident))
            dc.append(self.tables.get((0, slots >> 4)))
            ac.append(self.tables.get((1, slots & 15)))
        first, last, approx = head[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        order, units = self._order(parts)
        step = self.restart or units
        stretches = [coded] if not self.restart else _split_restarts(coded)
        table = {id(c): t for c, t in zip(parts, dc, strict=True)}
        for k, stretch in enumerate(stretches):
            a, z = k * step, min((k + 1) * step, units)
            raw = stretch.replace(b"\xff\0", b"\xff")
            piece = [(c, blocks[a:z]) for c, blocks in order]
            if first == 0:
                self._dc(raw, piece, table, high, low)
            else:
                self._ac(raw, parts[0], piece[0][1], ac[0], first, last, high, low)

    def _dc(self, raw: bytes, piece: list, table: dict, high: int, low: int) -> None:
        units = len(piece[0][1])
        if high:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: units * len(piece)].reshape(units, len(piece))
            for j, (c, blocks) in enumerate(piece):
                c["blocks"][blocks, 0] |= bits[:, j].astype(np.int32) << low
            return
        if all(t.even for t in table.values()) and len(raw) >= 2 * units * len(piece):
            word = np.frombuffer(raw, ">u2", units * len(piece)).astype(np.int32).reshape(units, len(piece))
            diff = np.empty_like(word)
            for j, (c, _) in enumerate(piece):
                diff[:, j] = table[id(c)].even_values(word[:, j])
        else:
            r, values = _Reader(raw), []
            for _ in range(units):
                for c, _blocks in piece:
                    values.append(r.signed(r.symbol(table[id(c)])))
            diff = np.array(values, dtype=np.int32).reshape(units, len(piece))
        for c in {id(c): c for c, _ in piece}.values():
            own = [j for j, (x, _) in enumerate(piece) if x is c]
            value = np.cumsum(diff[:, own].ravel()).reshape(units, len(own))
            for k, j in enumerate(own):
                c["blocks"][piece[j][1], 0] = value[:, k] << low

    def _ac(self, raw: bytes, c: dict, blocks: np.ndarray, table: Table, first: int, last: int, high: int, low: int) -> None:
        band, n, grid_ = last - first + 1, len(blocks), c["blocks"]
        pos = slice(first, last + 1)
        if not high:
            if len(raw) >= 2 * n * band and table.plain:
                size, code = table.plain
                word = np.frombuffer(raw, ">u2", n * band)
                if (word >> size == code).all():  # no runs: each word is one coefficient
                    v = (word & ((1 << size) - 1)).astype(np.int32)
                    v = np.where(v >> (size - 1), v, v - (1 << size) + 1)
                    grid_[blocks, pos] = v.reshape(n, band) << low
                    return
            self._ac_first(_Reader(raw), grid_, blocks, table, first, last, low)
        else:
            self._ac_refine(_Reader(raw), grid_, blocks, table, first, last, low)

    @staticmethod
    def _ac_first(r: _Reader, grid_, blocks, table, first, last, low) -> None:
        skip = 0
        for b in blocks.tolist():
            if skip:
                skip -= 1
                continue
            k = first
            while k <= last:
                s = r.symbol(table)
                run, size = s >> 4, s & 15
                if size:
                    k += run
                    grid_[b, k] = r.signed(size) * (1 << low)
                elif run == 15:
                    k += 15
                else:
                    skip = (1 << run) + r.get(run) - 1
                    break
                k += 1

    @staticmethod
    def _ac_refine(r: _Reader, grid_, blocks, table, first, last, low) -> None:
        one = 1 << low

        def correct(row: np.ndarray, b: int) -> None:
            """Correction bits of the coefficients in row that are not zero."""
            at = np.flatnonzero(grid_[b, row])
            got = r.bits[r.at : r.at + len(at)].astype(np.int32)
            r.at += len(at)
            cell = row[at]
            grid_[b, cell] += np.sign(grid_[b, cell]) * got * one

        i, n = 0, len(blocks)
        whole = np.arange(first, last + 1)
        while i < n:
            b, k = blocks[i], first
            while k <= last:
                s = r.symbol(table)
                run, size = s >> 4, s & 15
                if not size and run < 15:
                    count = (1 << run) + r.get(run)
                    correct(np.arange(k, last + 1), b)
                    rest = blocks[i + 1 : i + count]
                    part = grid_[rest][:, whole]
                    seen = part != 0
                    got = r.bits[r.at : r.at + int(seen.sum())].astype(np.int32)
                    r.at += len(got)
                    part[seen] += np.sign(part[seen]) * got * one
                    grid_[rest[:, None], whole] = part
                    i += count - 1
                    break
                new = (one if r.get(1) else -one) if size else 0
                stop = k
                while stop <= last:
                    if grid_[b, stop] == 0:
                        if run == 0:
                            break
                        run -= 1
                    stop += 1
                correct(np.arange(k, min(stop, last + 1)), b)
                if new and stop <= last:
                    grid_[b, stop] = new
                k = stop + 1
            i += 1

    def coefficients(self) -> list[np.ndarray]:
        """Each component's quantised coefficients, (blocks, 64) in zigzag order."""
        return [c["blocks"] for c in self.components]

    def rgb(self) -> np.ndarray:
        """The full-resolution image, (height, width, 3) bytes."""
        planes = []
        for c in self.components:
            square = np.zeros(c["blocks"].shape, dtype=np.float32)
            square[:, ZIGZAG] = c["blocks"] * self.quant[c["q"]]
            pixels = np.matmul(np.matmul(_COS, square.reshape(-1, 8, 8)), _COS.T) + 128
            plane = pixels.reshape(c["down"], c["across"], 8, 8).swapaxes(1, 2).reshape(8 * c["down"], 8 * c["across"])
            plane = np.clip(np.rint(plane), 0, 255).astype(np.float32)
            planes.append(plane.repeat(self.v // c["v"], axis=0).repeat(self.h // c["h"], axis=1)[: self.height, : self.width])
        if len(planes) == 1:
            planes *= 3
            return np.stack(planes, axis=-1).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes that ``encode_payload`` stored."""
        if self.tag is None:
            raise ValueError("the image holds no payload")
        (n,) = struct.unpack(">Q", self.tag)
        coded = np.concatenate(self.coefficients())
        return np.where(coded > 0, coded, coded + 255).astype(np.uint8).tobytes()[:n]


def _split_restarts(coded: bytes) -> list[bytes]:
    """Entropy-coded stretches between restart markers."""
    out, start, at = [], 0, 0
    while (at := coded.find(b"\xff", at)) >= 0:
        if 0xD0 <= coded[at + 1] <= 0xD7:
            out.append(coded[start:at])
            start = at + 2
        at += 2
    return [*out, coded[start:]]


def decode(data: bytes) -> Decoder:
    return Decoder(data)
