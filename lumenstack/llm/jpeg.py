"""Progressive JPEG in array operations: a decoder for 8-bit Huffman progressive
files and an encoder that stores coefficients as they are.

Entropy-coded data can only be read in order, but restart intervals are
independent of one another. So all intervals of one scan, of all files of a
batch that share the scan's parameters, advance in lockstep: one array operation
reads a symbol in each of them. Files without restart markers are decoded
too, one lane each.

Scans accumulate in coefficient arrays (spectral selection by band, successive
approximation by bit). The inverse transform is one matrix product with an
integer matrix, exact in float64, so that results never depend on batching.
"""

from __future__ import annotations

import heapq
import struct
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_SCALE_BITS = 20


def _inverse() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: pixels; scaled to integers."""
    x = np.arange(8)
    basis = np.array([np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)])
    every = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(every[_ZIGZAG] * (1 << _SCALE_BITS))


_IDCT = _inverse()


# Huffman tables


def _lengths(weights: dict[int, int]) -> dict[int, int]:
    """Code lengths by Huffman's algorithm; a reserved entry keeps the code of
    all ones unused."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(weights.items())] + [(0, 999, (-1,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*weights, -1], 0)
    count = 1000
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], count, a[2] + b[2]))
        count += 1
    assert max(depth.values()) <= 16
    del depth[-1]
    return depth


class Table:
    """A Huffman table: counts by length and symbols, as in the DHT segment."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.spec = bytes(counts) + bytes(symbols)
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.symbol_at, self.size_at = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                s = symbols[k]
                self.code[s], self.size[s] = code, length
                lo = code << (16 - length)
                self.symbol_at[lo : lo + (1 << (16 - length))] = s
                self.size_at[lo : lo + (1 << (16 - length))] = length
                code, k = code + 1, k + 1
            code <<= 1

    @classmethod
    def of(cls, weights: dict[int, int]) -> Table:
        depth = _lengths(weights)
        order = sorted(depth, key=lambda s: (depth[s], s))
        return cls(bytes(sum(d == n for d in depth.values()) for n in range(1, 17)), bytes(order))


_DC = Table.of({s: w for s, w in enumerate([8, 4, 6, 8, 12, 16, 12, 8, 2, 1, 1, 1])})
_EVERY_AC = [r << 4 | s for r in range(16) for s in range(11) if s or r < 15] + [0xF0]
_AC_FIRST = Table.of({s: {6: 4000, 5: 1500, 0: 300, 7: 300, 4: 150, 0x16: 60}.get(s, 1) for s in _EVERY_AC})
_AC_REFINE = Table.of({s: {0: 300, 1: 100, 0x11: 20, 0xF0: 10}.get(s, 1) for s in _EVERY_AC if s & 15 < 2})

# Encoder

#: MCUs of a restart interval.
RESTART = 4
#: (components, first and last coefficient, high and low bit)
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]
_BITS = np.array([int(i).bit_length() for i in range(1 << 12)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _pack_bits(value: np.ndarray, size: np.ndarray, seg: np.ndarray, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments and each segment's first byte (and the end); the
    symbols of a segment are in order, segments start at bytes, gaps are ones."""
    bits = np.bincount(seg, size, n_seg).astype(np.int64)
    first = np.concatenate([[0], np.cumsum((bits + 7) >> 3)])
    run = np.cumsum(size) - size
    at = run - (np.cumsum(bits) - bits)[seg] + first[seg] * 8
    reach = (int(size.max(initial=1)) + 14) >> 3  # bytes that a symbol can touch
    wide = value << (8 * reach - size - (at & 7))
    byte = at >> 3
    buf = np.zeros(int(first[-1]) + reach)
    for j in range(reach):
        # bits of different symbols never overlap, so sums are unions
        buf += np.bincount(byte + j, (wide >> (8 * (reach - 1 - j))) & 0xFF, len(buf))
    out = buf[: int(first[-1])].astype(np.uint8)
    gap = -bits & 7
    some = gap > 0
    out[first[1:][some] - 1] |= ((1 << gap[some]) - 1).astype(np.uint8)
    return out, first


def _entropy(value: np.ndarray, size: np.ndarray, seg: np.ndarray, segs_of_file: np.ndarray) -> list[bytes]:
    """The entropy-coded data of one scan of each file: stuffed bytes, with
    restart markers between a file's segments."""
    n_seg = int(segs_of_file.sum())
    data, first = _pack_bits(value, size, seg, n_seg)
    full = data == 0xFF
    before = np.concatenate([[0], np.cumsum(full)])
    nth = np.arange(n_seg) - np.repeat(np.cumsum(segs_of_file) - segs_of_file, segs_of_file)
    marks = nth > 0
    marked = np.cumsum(marks)
    shift = np.repeat(2 * marked, np.diff(first))
    place = np.arange(len(data)) + before[:-1] + shift
    out = np.zeros(len(data) + int(before[-1]) + 2 * int(marked[-1] if n_seg else 0), np.uint8)
    out[place] = data
    begin = first[:-1] + before[first[:-1]] + 2 * marked
    out[begin[marks] - 2] = 0xFF
    out[begin[marks] - 1] = 0xD0 + (nth[marks] - 1) % 8
    files = np.cumsum(segs_of_file) - segs_of_file
    cuts = np.append(begin[files], len(out))
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def _symbols_dc(blocks: np.ndarray, unit: np.ndarray, restart: np.ndarray, component: np.ndarray, low: int, high: int) -> tuple:
    """blocks: DC values in scan order."""
    if high:
        return (blocks >> low) & 1, np.ones(len(blocks), np.int64), unit
    v = blocks >> low
    diff = v.copy()
    for c in np.unique(component):
        own = np.flatnonzero(component == c)
        prev = np.concatenate([[0], v[own][:-1]])
        prev[np.concatenate([[True], restart[own][1:] != restart[own][:-1]])] = 0
        diff[own] = v[own] - prev
    size = _BITS[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return _DC.code[size] << size | extra, _DC.size[size] + size, unit


def _symbols_ac_first(band: np.ndarray, low: int) -> tuple:
    size_band = band.shape[1]
    mag = np.abs(band) >> low
    some = mag > 0
    last = np.where(some.any(1), size_band - 1 - some[:, ::-1].argmax(1), -1)
    row, col = np.nonzero(np.concatenate([some, (last < size_band - 1)[:, None]], 1))
    end = col == size_band
    new = np.concatenate([[True], row[1:] != row[:-1]])
    run = np.where(end, 0, col - np.where(new, -1, np.concatenate([[0], col[:-1]])) - 1)
    m = mag[row, np.minimum(col, size_band - 1)] * ~end
    size = _BITS[m]
    extra = np.where(band[row, np.minimum(col, size_band - 1)] < 0, (1 << size) - 1 - m, m)
    symbol = (run & 15) << 4 | size
    value, bits = _AC_FIRST.code[symbol] << size | extra, _AC_FIRST.size[symbol] + size
    if (skips := run >> 4).any():
        value, bits, row = _with_skips(value, bits, row, skips, _AC_FIRST)
    return value, bits, row


def _with_skips(value: np.ndarray, bits: np.ndarray, row: np.ndarray, skips: np.ndarray, table: Table) -> tuple:
    """Before each symbol, ``skips`` symbols for 16 zeros."""
    own = np.cumsum(skips + 1) - 1
    v, b = np.full(own[-1] + 1, table.code[0xF0]), np.full(own[-1] + 1, table.size[0xF0])
    v[own], b[own] = value, bits
    return v, b, np.repeat(row, skips + 1)


def _symbols_ac_refine(band: np.ndarray, low: int) -> tuple:
    mag = np.abs(band) >> low
    new, old = mag == 1, mag > 1
    if not new.any():
        return _corrections_only(mag, old)
    zero = ~new & ~old
    left = new[:, ::-1].cumsum(1)[:, ::-1]  # new ones from here on
    zeros = zero.cumsum(1)
    since = zeros - np.maximum.accumulate(np.where(new, zeros, 0), 1)  # zeros after the last new one
    skip = zero & (since % 16 == 0) & (left > 0)
    end = ~new[:, -1:]
    kind = np.concatenate([np.where(new, 1, np.where(old, 2, np.where(skip, 3, 0))), np.where(end, 4, 0)], 1)
    row, col = np.nonzero(kind)
    kind = kind[row, col]
    at = np.minimum(col, band.shape[1] - 1)
    # a new coefficient's zeros: those since the last new one, before it
    prior = np.where(at > 0, since[row, np.maximum(at - 1, 0)], 0)
    symbol = np.select([kind == 1, kind == 3], [(prior & 15) << 4 | 1, 0xF0], 0)
    sign = (band[row, at] > 0).astype(np.int64)
    value = np.select([kind == 2, kind == 1], [mag[row, at] & 1, _AC_REFINE.code[symbol] << 1 | sign], _AC_REFINE.code[symbol])
    bits = np.select([kind == 2, kind == 1], [1, _AC_REFINE.size[symbol] + 1], _AC_REFINE.size[symbol])
    # a symbol precedes the correction bits that it passes
    index = np.arange(len(kind))
    is_symbol = kind != 2
    where = np.flatnonzero(is_symbol)
    place = index + 1
    place[where] = np.concatenate([[0], where[:-1] + 1])
    trailing = where[-1] if len(where) else -1
    place[trailing + 1 :] = index[trailing + 1 :]
    v, b, r = np.empty_like(value), np.empty_like(bits), np.empty_like(row)
    v[place], b[place], r[place] = value, bits, row
    return v, b, r


def _corrections_only(mag: np.ndarray, old: np.ndarray) -> tuple:
    """Refinement of blocks without new coefficients: the end of the band, then
    a correction bit for each known one, eight columns at a time."""
    n, groups = len(mag), -(-mag.shape[1] // 8)
    value, bits = np.zeros((n, groups + 1), np.int64), np.zeros((n, groups + 1), np.int64)
    value[:, 0], bits[:, 0] = _AC_REFINE.code[0], _AC_REFINE.size[0]
    known, bit = np.ascontiguousarray(old.T).astype(np.int64), np.ascontiguousarray((mag & old).T)
    for k in range(mag.shape[1]):
        g = 1 + k // 8
        value[:, g] = value[:, g] << known[k] | bit[k]
        bits[:, g] += known[k]
    return value.ravel(), bits.ravel(), np.repeat(np.arange(n), groups + 1)


@lru_cache(4096)
def _mcu_order(width: int, height: int) -> np.ndarray:
    """The block numbers of a 4:2:0 image in MCU order; planes lie one after
    another, each row by row. MCUs x 6."""
    r, c = np.divmod(np.arange(width * height), width)
    y = [(2 * r + dr) * 2 * width + 2 * c + dc for dr in (0, 1) for dc in (0, 1)]
    return np.stack([*y, 4 * width * height + np.arange(width * height), 5 * width * height + np.arange(width * height)], 1)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Stores each payload (its length a multiple of 64) as the quantised
    coefficients of a progressive 4:2:0 JPEG: a byte, as a signed number, is a
    coefficient, so that reading coefficients gives the payload back exactly."""
    if not payloads:
        return []
    need = np.array([len(p) // 64 for p in payloads])
    mcus = np.maximum(1, -(-need // 6))
    wide = np.ceil(np.sqrt(mcus)).astype(np.int64)
    high = -(-mcus // wide)
    per_file = 6 * wide * high
    base = np.cumsum(per_file) - per_file
    coef = np.zeros((int(per_file.sum()), 64), np.int64)
    flat = coef.reshape(-1)
    for p, b in zip(payloads, base.tolist()):
        flat[b * 64 : b * 64 + len(p)] = np.frombuffer(p, np.int8)
    area = wide * high
    order = np.concatenate([_mcu_order(w, h).ravel() + b for w, h, b in zip(wide.tolist(), high.tolist(), base.tolist())])
    nth_mcu = np.arange(int(area.sum())) - np.repeat(np.cumsum(area) - area, area)
    planes = []
    for c in range(3):
        n = area * 4 if c == 0 else area
        start = base + (0 if c == 0 else (3 + c) * area)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        planes.append((np.repeat(start, n) + nth, n, nth))
    scans = []
    for comps, ss, se, ah, al in SCRIPT:
        if ss == 0:
            segs = -(-area // RESTART)
            of_mcu = np.repeat(np.cumsum(segs) - segs, area) + nth_mcu // RESTART
            seg = np.repeat(of_mcu, 6)
            value, bits, seg = _symbols_dc(coef[order, 0], seg, seg, np.tile([0, 0, 0, 0, 1, 2], len(nth_mcu)), al, ah)
        else:
            blocks, n, nth = planes[comps[0]]
            segs = -(-n // RESTART)
            of_block = np.repeat(np.cumsum(segs) - segs, n) + nth // RESTART
            value, bits, row = (_symbols_ac_refine if ah else _symbols_ac_first)(coef[blocks, ss : se + 1], al)
            seg = of_block[row]
        scans.append(_entropy(value, bits, seg, segs))
    tables = _segment(0xC4, b"\x00" + _DC.spec + b"\x10" + _AC_FIRST.spec + b"\x11" + _AC_REFINE.spec)
    head = b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([1]) * 64)
    sos = [_segment(0xDA, bytes([len(c)]) + b"".join(bytes([x + 1, (0 if ss == 0 else 1 if ah else 0)]) for x in c) + bytes([ss, se, ah << 4 | al])) for c, ss, se, ah, al in SCRIPT]
    out = []
    for i, (w, h) in enumerate(zip(wide.tolist(), high.tolist())):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"".join([head, frame, tables, _segment(0xDD, struct.pack(">H", RESTART)), *(x for s, d in zip(sos, scans) for x in (s, d[i])), b"\xff\xd9"]))
    return out


# Decoder


class JpegError(ValueError):
    pass


@dataclass
class _Component:
    ident: int
    h: int
    v: int
    quant: int
    across: int = 0  # blocks of the component itself
    down: int = 0
    stride: int = 0  # blocks with those that fill the last MCUs
    rows: int = 0
    base: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[_Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)
    blocks: int = 0
    base: int = 0
    shape: tuple = ()
    error: str | None = None
    coefficients: np.ndarray | None = None


@lru_cache(1024)
def _table(spec: bytes) -> Table:
    return Table(spec[:16], spec[16:])


@lru_cache(4096)
def _header(data: bytes) -> tuple[Image, dict[int, bytes], int]:
    """The segments before the first scan."""
    img, tables, restart, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG")
    while at < len(data):
        at, restart = _read_segment(img, tables, restart, data, at)
    if at != len(data):
        raise JpegError("cut short")
    return img, tables, restart


def _read_segment(img: Image, tables: dict[int, bytes], restart: int, data: bytes, at: int) -> tuple[int, int]:
    """One segment other than a scan's; where the next one begins, and the restart interval."""
    if at + 4 > len(data) or data[at] != 0xFF:
        raise JpegError("cut short")
    marker = data[at + 1]
    if marker == 0xFF:
        return at + 1, restart
    (n,) = struct.unpack_from(">H", data, at + 2)
    body = data[at + 4 : at + 2 + n]
    k = 0
    if marker == 0xDB:
        while k < len(body):
            wide, ident = body[k] >> 4, body[k] & 15
            step = 128 if wide else 64
            img.quants[ident] = np.frombuffer(body[k + 1 : k + 1 + step], ">u2" if wide else np.uint8).astype(np.int64)
            k += 1 + step
    elif marker == 0xC4:
        while k < len(body):
            n_sym = sum(body[k + 1 : k + 17])
            tables[body[k]] = bytes(body[k + 1 : k + 17 + n_sym])
            k += 17 + n_sym
    elif marker == 0xDD:
        (restart,) = struct.unpack(">H", body)
    elif marker == 0xC2:
        depth, img.height, img.width, n_comp = struct.unpack_from(">BHHB", body)
        if depth != 8 or not img.height or not img.width or not n_comp:
            raise JpegError("not supported: depth or size")
        img.components = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_comp)]
        if not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in img.components):
            raise JpegError("sampling factors out of range")
        hm, vm = max(c.h for c in img.components), max(c.v for c in img.components)
        mx, my = -(-img.width // (8 * hm)), -(-img.height // (8 * vm))
        for c in img.components:
            c.across, c.down = -(-(-(-img.width * c.h // hm)) // 8), -(-(-(-img.height * c.v // vm)) // 8)
            c.stride, c.rows, c.base = mx * c.h, my * c.v, img.blocks
            img.blocks += c.stride * c.rows
        img.shape = tuple((c.h, c.v, c.across, c.down, c.stride, c.rows, c.base) for c in img.components)
    elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
        raise JpegError("not a progressive Huffman file")
    return at + 2 + n, restart


@lru_cache(1024)
def _scan_header(body: bytes, idents: tuple[int, ...]) -> tuple:
    n_comp = body[0]
    ss, se, a = body[1 + 2 * n_comp : 4 + 2 * n_comp]
    if not (ss <= se < 64 and (ss or not se) and (not ss or n_comp == 1)):
        raise JpegError("band out of range")
    comps, keys = [], []
    for i in range(n_comp):
        if body[1 + 2 * i] not in idents:
            raise JpegError("scan of an unknown component")
        comps.append(idents.index(body[1 + 2 * i]))
        t = body[2 + 2 * i]
        keys.append(t >> 4 if ss == 0 else 0x10 | (t & 15))
    return tuple(comps), ss, se, a >> 4, a & 15, () if ss == 0 and a >> 4 else tuple(keys)


def _parse(data: bytes, offset: int, marks: list[int]) -> Image:
    """Headers and the places of the scans. marks: where in the batch a marker
    other than a restart begins."""
    at = data.find(b"\xff\xda")
    try:
        known, tables, restart = _header(data[: at if at >= 0 else len(data)])
        img = Image(known.width, known.height, known.components, dict(known.quants), blocks=known.blocks, shape=known.shape)
        tables = dict(tables)
    except JpegError as e:
        if str(e) != "cut short" or at < 0:
            raise
        img, tables, restart, at = Image(), {}, 0, 2  # those two bytes were part of a segment
    while at < len(data):
        marker = data[at + 1] if at + 1 < len(data) else 0
        if marker == 0xD9:
            break
        if marker != 0xDA:
            at, restart = _read_segment(img, tables, restart, data, at)
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        comps, ss, se, ah, al, keys = _scan_header(data[at + 4 : at + 2 + n], tuple(c.ident for c in img.components))
        if any(k not in tables for k in keys):
            raise JpegError("no such table")
        at += 2 + n
        k = bisect_left(marks, offset + at)
        end = min(marks[k] - offset, len(data)) if k < len(marks) else len(data)
        img.scans.append((comps, ss, se, ah, al, tuple(tables[k] for k in keys) or (b"",) * len(comps), restart, offset + at, offset + end))
        at = end
    if not img.components:
        raise JpegError("no frame")
    return img


@lru_cache(4096)
def _addresses(shape: tuple, comps: tuple[int, ...]) -> np.ndarray:
    """Units x blocks of a unit: block numbers in the order of a scan."""
    if len(comps) == 1:
        h, v, across, down, stride, rows, base = shape[comps[0]]
        r, c = np.divmod(np.arange(across * down), across)
        return (base + r * stride + c)[:, None]
    first = shape[comps[0]]
    wide = first[4] // first[0]
    n = wide * (first[5] // first[1])
    r, c = np.divmod(np.arange(n), wide)
    return np.stack([base + (r * v + dr) * stride + c * h + dc for h, v, _, _, stride, _, base in (shape[k] for k in comps) for dr in range(v) for dc in range(h)], 1)


class _Lanes:
    """Bit positions of many intervals, read together."""

    def __init__(self, window: np.ndarray, at: np.ndarray):
        self.window, self.at, self.limit = window, at, len(window) * 8 - 8
        self.bad = np.zeros(len(at), bool)

    def look(self, lanes: np.ndarray | slice) -> np.ndarray:
        at = self.at[lanes]
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def skip(self, lanes: np.ndarray | slice, n: np.ndarray | int) -> None:
        self.at[lanes] = np.minimum(self.at[lanes] + n, self.limit)

    def bit(self, lanes: np.ndarray | slice) -> np.ndarray:
        out = (self.look(lanes) >> np.uint64(63)).astype(np.int64)
        self.skip(lanes, 1)
        return out

    def symbol(self, lanes: np.ndarray | slice, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, its code's length, and the bits that follow (left-aligned)."""
        w = self.look(lanes)
        top = (w >> np.uint64(48)).astype(np.int64)
        size = table.size_at[top].astype(np.int64)
        self.bad[lanes] |= size == 0
        return table.symbol_at[top].astype(np.int64), np.maximum(size, 1), w << np.maximum(size, 1).astype(np.uint64)


def _signed(rest: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` bits as a number, those that begin with 0 negative."""
    raw = (rest >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
    return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)


def _unsigned(rest: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (rest >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)


def _run_scan(lanes: _Lanes, coef: np.ndarray, addr: np.ndarray, start: np.ndarray, units: np.ndarray, blocks_of_unit: int, slot: list[int], ss: int, se: int, ah: int, al: int, tables: list[Table]) -> None:
    """Decodes one scan in all lanes. addr[start + unit * blocks_of_unit + b]
    is a lane's block; lanes are sorted by falling ``units``."""
    predicted = np.zeros((len(units), max(slot) + 1), np.int64)
    ended = np.zeros(len(units), np.int64)  # blocks that an end-of-band run still covers
    for unit in range(int(units[0]) if len(units) else 0):
        live = slice(0, int(np.searchsorted(-units, -unit, side="left")))
        for b in range(blocks_of_unit):
            block = addr[start[live] + unit * blocks_of_unit + b]
            if ss == 0 and ah == 0:
                size, length, rest = lanes.symbol(live, tables[slot[b]])
                size = np.minimum(size, 16)
                lanes.skip(live, length + size)
                predicted[live, slot[b]] += _signed(rest, size)
                coef[block, 0] = predicted[live, slot[b]] << al
            elif ss == 0:
                coef[block, 0] |= (lanes.bit(live) << al).astype(coef.dtype)
            elif ah == 0:
                _ac_first(lanes, coef, block, ended[live], ss, se, al, tables[0])
            else:
                _ac_refine(lanes, coef, block, ended[live], ss, se, al, tables[0])


def _ac_first(lanes: _Lanes, coef: np.ndarray, block: np.ndarray, ended: np.ndarray, ss: int, se: int, al: int, table: Table) -> None:
    idle = ended > 0
    ended[idle] -= 1
    lane = np.flatnonzero(~idle)
    k = np.full(len(lane), ss)
    while len(lane):
        symbol, length, rest = lanes.symbol(lane, table)
        run, size = symbol >> 4, symbol & 15
        stop = (size == 0) & (run < 15)
        lanes.skip(lane, length + np.where(stop, run, size))
        if stop.any():
            s = np.flatnonzero(stop)
            ended[lane[s]] = (1 << run[s]) - 1 + _unsigned(rest[s], run[s])
        k = k + run
        put = (size > 0) & (k <= se)
        if put.all():
            coef[block[lane], k] = _signed(rest, size) << al
        else:
            coef[block[lane[put]], k[put]] = _signed(rest[put], size[put]) << al
        k += 1
        go = ~stop & (k <= se) & ~lanes.bad[lane]
        if not go.all():
            lane, k = lane[go], k[go]


def _ac_refine(lanes: _Lanes, coef: np.ndarray, block: np.ndarray, ended: np.ndarray, ss: int, se: int, al: int, table: Table) -> None:
    done = ended > 0  # no more symbols for this block
    ended[done] -= 1
    run = np.full(len(block), -1)  # zeros still to pass; -1: a symbol comes next
    value = np.zeros(len(block), np.int64)
    step = 1 << al
    for k in range(ss, se + 1):
        ask = np.flatnonzero((run < 0) & ~done)
        if len(ask):
            symbol, length, rest = lanes.symbol(ask, table)
            r, size = symbol >> 4, symbol & 15
            stop = (size == 0) & (r < 15)
            lanes.skip(ask, length + np.where(stop, r, size))
            s = ask[stop]
            ended[s] = (1 << r[stop]) - 1 + _unsigned(rest[stop], r[stop])
            done[s] = True
            go = ask[~stop]
            run[go] = r[~stop]
            value[go] = np.where(size[~stop] > 0, np.where(rest[~stop] >> np.uint64(63) > 0, step, -step), 0)
            done[ask[lanes.bad[ask]]] = True
        now = coef[block, k]
        old = np.flatnonzero(now)
        if len(old):
            c = now[old]
            coef[block[old], k] = c + np.where(lanes.bit(old) > 0, np.where(c > 0, step, -step), 0).astype(coef.dtype)
        if not done.all():
            zero = np.flatnonzero((now == 0) & ~done)
            put = zero[run[zero] == 0]
            coef[block[put], k] = value[put]
            run[zero] -= 1


def decode_coefficients(files: list[bytes]) -> list[Image]:
    """The coefficient arrays of every file (blocks x 64, zigzag order), or why there are none."""
    whole = np.frombuffer(b"".join(files) + bytes(16), np.uint8)
    full = whole[:-1] == 0xFF
    nxt = whole[1:]
    is_restart = full & (nxt >= 0xD0) & (nxt <= 0xD7)
    marks = np.flatnonzero(full & (nxt != 0) & (nxt != 0xFF) & ~is_restart).tolist()
    restarts = np.flatnonzero(is_restart)
    restart_list = restarts.tolist()
    keep = np.concatenate([[True], ~(full & (nxt == 0))])
    moved = np.cumsum(keep) - 1  # where a byte is once stuffed zeros are gone
    plain = np.concatenate([whole[keep], np.zeros(16, np.uint8)]).astype(np.uint64)
    n = len(plain) - 8
    window = np.zeros(n, np.uint64)
    for j in range(8):
        window |= plain[j : j + n] << np.uint64(56 - 8 * j)
    images, offset, total = [], 0, 0
    for data in files:
        try:
            img = _parse(data, offset, marks)
        except (JpegError, struct.error, IndexError, ValueError) as e:
            img = Image(error=str(e) or "cut short")
        img.base = total
        total += img.blocks
        offset += len(data)
        images.append(img)
    coef = np.zeros((total, 64), np.int16)
    for nth in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, img in enumerate(images):
            if nth < len(img.scans) and not img.error:
                comps, ss, se, ah, al, specs, *_ = img.scans[nth]
                layout = tuple((img.components[c].h, img.components[c].v) for c in comps) if len(comps) > 1 else ()
                groups.setdefault((comps, ss, se, ah, al, specs, layout), []).append(i)
        for (comps, ss, se, ah, al, specs, layout), members in groups.items():
            _decode_group(images, members, nth, comps, ss, se, ah, al, [_table(s) if s else None for s in specs], layout, coef, window, moved, restarts, restart_list)
    for img in images:
        img.coefficients = coef[img.base : img.base + img.blocks]
    return images


def _decode_group(images: list[Image], members: list[int], nth: int, comps: tuple, ss: int, se: int, ah: int, al: int, tables: list, layout: tuple, coef: np.ndarray, window: np.ndarray, moved: np.ndarray, restarts: np.ndarray, restart_list: list[int]) -> None:
    addrs, firsts, units, begins, owners = [], [], [], [], []
    held = 0
    for i in members:
        img = images[i]
        *_, restart, lo, hi = img.scans[nth]
        a = _addresses(img.shape, comps)
        n = len(a)
        every = restart or n
        lanes = -(-n // every)
        own = restarts[bisect_left(restart_list, lo) : bisect_left(restart_list, hi)]
        if len(own) < lanes - 1:
            img.error = "restart markers are missing"
            continue
        addrs.append(a.ravel() + img.base)
        first = np.arange(lanes) * every
        firsts.append(held + first * a.shape[1])
        units.append(np.minimum(every, n - first))
        begins.append(np.concatenate([[lo], own[: lanes - 1] + 2]))
        owners.append(np.full(lanes, i))
        held += a.size
    if not addrs:
        return
    unit = np.concatenate(units)
    order = np.argsort(-unit, kind="stable")
    at = moved[np.minimum(np.concatenate(begins), len(moved) - 1)][order] * 8
    lanes = _Lanes(window, at)
    slot = [j for j, (h, v) in enumerate(layout) for _ in range(h * v)] if layout else [0]
    _run_scan(lanes, coef, np.concatenate(addrs), np.concatenate(firsts)[order], unit[order], len(slot), slot, ss, se, ah, al, tables)
    for i in np.unique(np.concatenate(owners)[order][lanes.bad]):
        images[i].error = "broken entropy-coded data"


def planes(images: list[Image]) -> list[list[np.ndarray]]:
    """8-bit sample planes of each component, cut to the component's size in blocks."""
    out = []
    for img in images:
        own = []
        for c in img.components if not img.error else []:
            if c.quant not in img.quants:
                img.error = "no such quantisation table"
                break
            blocks = img.coefficients[c.base : c.base + c.stride * c.rows] * img.quants[c.quant]
            pixels = samples(blocks).reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3)
            own.append(pixels.reshape(c.rows * 8, c.stride * 8))
        out.append(own)
    return out


def samples(blocks: np.ndarray) -> np.ndarray:
    """The inverse transform: blocks x 64 coefficients to blocks x 64 samples."""
    out = np.empty(blocks.shape, np.uint8)
    for lo in range(0, len(blocks), 4096):  # bounds the float copy
        x = blocks[lo : lo + 4096].astype(np.float64) @ _IDCT
        x += (1 << _SCALE_BITS - 1) + (128 << _SCALE_BITS)
        x *= 1 / (1 << _SCALE_BITS)  # a power of two: exact
        np.clip(np.floor(x, out=x), 0, 255, out=x)
        out[lo : lo + 4096] = x
    return out


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, across: int, down: int) -> np.ndarray:
    """Full-range conversion in 16-bit fixed point; the last axis is RGB. What
    chroma adds to each channel is found at its own resolution, then repeated
    ``down`` and ``across`` times to the size of ``y``."""
    cb, cr = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15
    h, w = y.shape
    luma = y.astype(np.int16)
    rgb = np.empty((h, w, 3), np.uint8)
    for c, add in enumerate(((91881 * cr + half) >> 16, -((22554 * cb + 46802 * cr + half) >> 16), (116130 * cb + half) >> 16)):
        full = np.repeat(np.repeat(add.astype(np.int16), down, 0), across, 1)[:h, :w]
        rgb[..., c] = np.clip(luma + full, 0, 255)
    return rgb


def rgb_tensors(images: list[Image]) -> list[np.ndarray | None]:
    """height x width x 3 of each image, chroma upsampled by repetition; None on error."""
    out: list[np.ndarray | None] = []
    for img, own in zip(images, planes(images)):
        if not img.error and not (len(own) in (1, 3) and all(img.components[0].h % c.h == 0 and img.components[0].v % c.v == 0 for c in img.components)):
            img.error = "neither grey nor YCbCr with evenly subsampled chroma"
        if img.error:
            out.append(None)
            continue
        y = own[0][: img.height, : img.width]
        if len(own) == 1:
            out.append(np.repeat(y[..., None], 3, -1))
            continue
        first, b, r = img.components
        if (b.h, b.v) == (r.h, r.v):
            out.append(to_rgb(y, own[1], own[2], first.h // b.h, first.v // b.v))
        else:
            full = [np.repeat(np.repeat(p, first.v // c.v, 0), first.h // c.h, 1)[: img.height, : img.width] for p, c in zip(own[1:], (b, r))]
            out.append(to_rgb(y, *full, 1, 1))
    return out
