"""Progressive JPEG in numpy: scans are accumulated into coefficient arrays, inverse-transformed and stored as RGB tensors.

The decoder takes DC and AC scans, spectral selection, successive approximation, zero runs, end-of-band runs, restart
intervals and any sampling factors of 8-bit images with one or three components. The restart intervals of many files
are decoded in lockstep: every step takes one symbol from each of them, by array operations. The encoder writes
coefficient arrays as progressive scans with restart intervals, many images at once.

Byte payloads are stored in the coefficients, the unit in which the format is lossless, of a 4:2:0 image: a frequent
byte is a small coefficient and the space is zero, so scans have zero runs, bands that end early and magnitudes of all
sizes, and samples look like samples.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a payload's unit; an MCU of a payload image has two: four blocks of luminance and two of chroma.
UNIT, MCU_BYTES = 192, 384
#: Bytes in the order of their frequency in prose; the others follow by value (fixed values).
FREQUENT = b" enairtsolduhcmgpbvfwkzyjxq,.\n"
#: MCUs of an image row; units of a payload image's restart interval.
MOST_COLUMNS, INTERVAL = 4095, 4
#: Blocks that an image may have to be decoded: 64 million samples, half a gigabyte of work space.
MOST_BLOCKS = 1 << 20
#: Bytes of payload or files that are encoded or decoded together.
TOGETHER = 1 << 21
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Bands that one end-of-band run may end.
MOST_RUN = 32767


def _zigzag() -> np.ndarray:
    """Position k of the zigzag to its place in the 8x8 block, row by row."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()
SCALE = 13


def _basis() -> np.ndarray:
    """Inverse transform of a block in zigzag order as whole numbers scaled by 2**SCALE: sums are exact in doubles, so equal blocks give equal samples in any batch."""
    x, u = np.arange(8), np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    whole = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return np.round(whole[ZIGZAG] * (1 << SCALE))


BASIS = _basis()


class Geometry:
    """Where the blocks of an image's components lie in one array, and the order in which scans visit them."""

    def __init__(self, width: int, height: int, sampling: tuple[tuple[int, int], ...]):
        if not (width and height and all(1 <= x <= 4 for hv in sampling for x in hv)):
            raise ValueError("no size, or sampling factors out of range")
        self.width, self.height, self.sampling = width, height, sampling
        hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.rows, self.cols = -(-height // (8 * vm)), -(-width // (8 * hm))
        self.shapes = [(self.rows * v, self.cols * h) for h, v in sampling]
        self.starts = np.cumsum([0, *(r * c for r, c in self.shapes)]).tolist()
        self.blocks = self.starts[-1]
        self._orders: dict = {}

    def order(self, chosen: tuple[int, ...]) -> np.ndarray:
        """units x blocks of a unit: MCUs of several components, or the blocks that a single component's samples need."""
        if chosen not in self._orders:
            whole = [np.arange(self.starts[i], self.starts[i + 1]).reshape(self.shapes[i]) for i in chosen]
            if len(chosen) > 1:
                parts = [w.reshape(self.rows, self.sampling[i][1], self.cols, self.sampling[i][0]).transpose(0, 2, 1, 3).reshape(self.rows * self.cols, -1) for w, i in zip(whole, chosen)]
                found = np.concatenate(parts, axis=1)
            else:
                h, v = self.sampling[chosen[0]]
                hm, vm = max(x for x, _ in self.sampling), max(x for _, x in self.sampling)
                rows, cols = -(-(-(-self.height * v // vm)) // 8), -(-(-(-self.width * h // hm)) // 8)
                found = whole[0][:rows, :cols].reshape(-1, 1)
            self._orders[chosen] = found
        return self._orders[chosen]

    def of_unit(self, chosen: tuple[int, ...]) -> tuple[int, ...]:
        """The component (place in ``chosen``) of each block of a unit."""
        return tuple(k for k, i in enumerate(chosen) for _ in range(self.sampling[i][0] * self.sampling[i][1])) if len(chosen) > 1 else (0,)


geometry = lru_cache(maxsize=1024)(Geometry)


@dataclass
class Image:
    """coef: blocks x 64 in zigzag order, component after component, padded to whole MCUs."""

    geometry: Geometry
    coef: np.ndarray
    quant: list[np.ndarray]
    idents: tuple[int, ...] = (1, 2, 3)
    interval: int = 0
    comment: bytes = b""

    def part(self, i: int) -> np.ndarray:
        """rows x columns x 64 of a component."""
        g = self.geometry
        return self.coef[g.starts[i] : g.starts[i + 1]].reshape(*g.shapes[i], 64)


# ---- Huffman codes


class Code:
    """A canonical code for symbols with weights; the code of all ones stays unused, as the format demands."""

    def __init__(self, weights: dict[int, float]):
        least = sum(weights.values()) / 8192  # keeps codes within 16 bits
        heap = [(max(w, least), i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, -1, (-1,))]
        heapq.heapify(heap)
        depth = dict.fromkeys([*weights, -1], 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        order = sorted(weights, key=lambda s: (depth[s], s))
        self.counts = bytes(sum(depth[s] == n for s in order) for n in range(1, 17))
        self.symbols = bytes(order)
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        code, before = 0, depth[order[0]]
        for s in order:
            code <<= depth[s] - before
            self.code[s], self.length[s], before = code, depth[s], depth[s]
            code += 1

    def segment(self, kind: int, ident: int) -> bytes:
        return _segment(0xC4, bytes([kind << 4 | ident]) + self.counts + self.symbols)


#: DC differences by size; AC symbols by zero run and size with end-of-band runs; refinements.
DC_CODE = Code({n: 2.0 ** -abs(n - 3) for n in range(12)})
AC_CODE = Code({r << 4 | n: 2.0 ** (-r - abs(n - 3)) for r in range(16) for n in range(1, 11)} | {0xF0: 2.0**-9} | {n << 4: 2.0 ** (-3 - n) for n in range(15)})
REFINE_CODE = Code({r << 4 | 1: 2.0 ** (-r / 3) for r in range(16)} | {0xF0: 2.0**-5} | {n << 4: 2.0 ** (-1 - n) for n in range(15)})


@lru_cache(maxsize=256)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """The next 16 bits to symbol << 5 | code length; 0 for no code."""
    table, code, k = np.zeros(65536, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            if low + (1 << (16 - length)) > 65536:
                raise ValueError("more codes than fit")
            table[low : low + (1 << (16 - length))] = symbols[k] << 5 | length
            code, k = code + 1, k + 1
        code <<= 1
    return table


# ---- encoder


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _bits_of(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _packed(word: np.ndarray, length: np.ndarray, interval: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of some bits, in order, to bytes: every interval is filled with ones, stuffed and, but for a scan's last, followed by its restart marker.

    interval: of each word; last, number: of each interval. Also returns where each interval's bytes end.
    """
    bits = np.bincount(interval, length, len(last)).astype(np.int64)
    size = (bits + 7) >> 3
    first_bit = (np.cumsum(size) - size) * 8
    at = np.cumsum(length) - length + (first_bit - (np.cumsum(bits) - bits))[interval]
    filled = size * 8 - bits
    word, length, at = np.r_[word, (1 << filled) - 1], np.r_[length, filled], np.r_[at, first_bit + bits]
    # A word of up to 32 bits lies in one or two slots of 32; slots are sums, as no two words share a bit.
    wide = (word.astype(np.uint64) << (64 - np.maximum(length, 1)).astype(np.uint64)) >> (at & 31).astype(np.uint64)
    n = int(size.sum() >> 2) + 2
    slots = np.bincount(at >> 5, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount((at >> 5) + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    raw = np.frombuffer(slots.astype(">u4").tobytes(), np.uint8)[: int(size.sum())]
    ends = np.cumsum(size) - 1
    room = np.ones(len(raw), np.int64) + (raw == 0xFF)
    marked = ends[~last]
    room[marked] += 2
    after = np.cumsum(room)
    out = np.zeros(int(after[-1]), np.uint8)
    out[after - room] = raw
    out[after[marked] - 2] = 0xFF
    out[after[marked] - 1] = 0xD0 + (number[~last] & 7)
    return out, after[ends]


def _dc_words(values: np.ndarray, unit: tuple[int, ...], fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of units x blocks to the block before of the same component; ``fresh`` units start an interval."""
    diffs = np.empty_like(values)
    for c in sorted(set(unit)):
        mine = [i for i, x in enumerate(unit) if x == c]
        for a, b in zip(mine, mine[1:]):
            diffs[:, b] = values[:, b] - values[:, a]
        before = np.r_[0, values[:-1, mine[-1]]]
        diffs[:, mine[0]] = values[:, mine[0]] - np.where(fresh, 0, before)
    d = diffs.reshape(-1)
    size = _bits_of(np.abs(d))
    return DC_CODE.code[size] << size | np.where(d < 0, d + (1 << size) - 1, d), DC_CODE.length[size] + size


def _runs_of_ends(eob: np.ndarray, empty: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks at which a run of ended bands starts, and its length: blocks with nothing to say join the run before, within an interval and up to MOST_RUN."""
    joins = eob & empty & ~fresh & np.r_[False, eob[:-1]]
    at = np.arange(len(eob))
    begins = np.maximum.accumulate(np.where(joins, 0, at))
    joins &= (at - begins) % MOST_RUN != 0
    starts = np.flatnonzero(eob & ~joins)
    run = np.cumsum(eob & ~joins) - 1
    return starts, np.bincount(run[eob], minlength=len(starts))


def _ac_first_words(band: np.ndarray, low: int, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, lengths and blocks of a band's first scan."""
    level = np.abs(band) >> low
    block, k = np.nonzero(level)
    width, n_blocks = band.shape[1], len(band)
    m = level[block, k].astype(np.int64)
    same = np.r_[False, block[1:] == block[:-1]]
    run = k - np.where(same, np.r_[0, k[:-1]], -1) - 1
    size = _bits_of(m)
    symbol = (run & 15) << 4 | size
    word = AC_CODE.code[symbol] << size | np.where(band[block, k] < 0, (1 << size) - 1 - m, m)
    length = AC_CODE.length[symbol] + size
    last = np.full(n_blocks, -1)
    last[block] = k
    starts, runs = _runs_of_ends(last < width - 1, last < 0, fresh)
    extra = _bits_of(runs) - 1
    ends = AC_CODE.code[extra << 4] << extra | (runs - (1 << extra)), AC_CODE.length[extra << 4] + extra
    long = run >> 4
    more = np.repeat(np.arange(len(run)), long)
    at = np.r_[block * 128 + 2 * k + 1, block[more] * 128 + 2 * k[more], starts * 128 + 127] if width < 64 else None
    order = np.argsort(at, kind="stable")
    zrl = np.full(len(more), 0xF0)
    return np.r_[word, AC_CODE.code[zrl], ends[0]][order], np.r_[length, AC_CODE.length[zrl], ends[1]][order], np.r_[block, block[more], starts][order]


def _ac_refine_words(band: np.ndarray, low: int, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As above, for one more bit of what is known to be non-zero and for what becomes non-zero with it.

    Between new coefficients lie zeros, 16 of which at a time take a symbol, and known ones, each with its bit behind
    the symbol that passes it.
    """
    level = np.abs(band) >> low
    new, known = level == 1, level > 1
    count = np.cumsum(new, axis=1, dtype=np.int8)
    gap = count - new  # new coefficients before
    zeros = np.cumsum(level == 0, axis=1, dtype=np.int8)
    block, k = np.nonzero(new)
    at_new, same = zeros[block, k].astype(np.int64), np.r_[False, block[1:] == block[:-1]]
    before = np.where(same, np.r_[0, at_new[:-1]], 0)  # zeros before the gap
    run = at_new - before
    symbol = (run & 15) << 4 | 1
    word = REFINE_CODE.code[symbol] << 1 | (band[block, k] > 0)
    length = REFINE_CODE.length[symbol] + 1
    key = lambda b, g, sub, k: ((b * 64 + g) * 8 + sub) * 128 + k
    long = run >> 4
    more = np.repeat(np.arange(len(run)), long)
    sub = np.arange(len(more)) - np.repeat(np.cumsum(long) - long, long)
    total = count[:, -1].astype(np.int64)
    last = np.full(len(band), -1)
    last[block] = k
    starts, runs = _runs_of_ends(last < band.shape[1] - 1, last < 0, fresh)
    extra = _bits_of(runs) - 1
    b, p = np.nonzero(known)
    g = gap[b, p].astype(np.int64)
    first = np.zeros(len(band) + 1, np.int64)
    first[1:] = np.cumsum(total)
    inside = g < total[b]
    its = np.minimum(first[b] + g, max(len(before) - 1, 0))
    passed = np.where(inside, (zeros[b, p] - (before[its] if len(before) else 0)) >> 4, 0)
    keys = np.r_[key(block, gap[block, k].astype(np.int64), long, 0), key(block[more], gap[block, k][more], sub, 0), key(starts, total[starts], 0, 0), key(b, g, passed, 1 + p)]
    order = np.argsort(keys, kind="stable")
    zrl = np.full(len(more), 0xF0)
    words = np.r_[word, REFINE_CODE.code[zrl], REFINE_CODE.code[extra << 4] << extra | (runs - (1 << extra)), level[b, p] & 1]
    lengths = np.r_[length, REFINE_CODE.length[zrl], REFINE_CODE.length[extra << 4] + extra, np.ones(len(b), np.int64)]
    return words[order], lengths[order], np.r_[block, block[more], starts, b][order]


def script(parts: int) -> list[tuple[tuple[int, ...], int, int, int, int]]:
    """(components, first and last coefficient, high and low bit) of the scans.

    DC without its last bit; luminance in two bands without their last bit; chroma in two whole bands; then the last bits
    of DC and luminance.
    """
    every = tuple(range(parts))
    chroma = [((i,), a, z, 0, 0) for i in every[1:] for a, z in ((1, 9), (10, 63))]
    return [(every, 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), *chroma, (every, 0, 0, 1, 0), ((0,), 1, 63, 1, 0)]


def encode_many(images: list[Image]) -> list[bytes]:
    """Progressive files of images that have the same sampling factors."""
    if any(im.geometry.sampling != images[0].geometry.sampling for im in images):
        raise ValueError("images of one call have the same sampling factors")
    parts = len(images[0].geometry.sampling)
    coef = np.concatenate([im.coef for im in images])
    base = np.cumsum([0, *(len(im.coef) for im in images)]).tolist()
    out = []
    for im in images:
        g = im.geometry
        tables = [np.asarray(q) for q in im.quant]
        head = [b"\xff\xd8", *(_segment(0xDB, bytes([i]) + bytes(q.tolist())) for i, q in enumerate(tables)), DC_CODE.segment(0, 0), AC_CODE.segment(1, 0), REFINE_CODE.segment(1, 1)]
        if im.comment:
            head.append(_segment(0xFE, im.comment))
        frame = bytes([8]) + g.height.to_bytes(2, "big") + g.width.to_bytes(2, "big") + bytes([parts])
        head.append(_segment(0xC2, frame + b"".join(bytes([im.idents[i], h << 4 | v, min(i, len(tables) - 1)]) for i, (h, v) in enumerate(g.sampling))))
        if im.interval:
            head.append(_segment(0xDD, im.interval.to_bytes(2, "big")))
        out.append(head)
    for chosen, start, end, high, low in script(parts):
        orders = [im.geometry.order(chosen) for im in images]
        units = np.array([len(o) for o in orders])
        steps = np.array([im.interval or n for im, n in zip(images, units)])
        rows = np.concatenate([o.reshape(-1) + a for o, a in zip(orders, base)])
        owner = np.repeat(np.arange(len(images)), units)
        unit = np.arange(units.sum()) - (np.cumsum(units) - units)[owner]
        number = unit // steps[owner]
        fresh = unit % steps[owner] == 0
        interval = np.cumsum(fresh) - 1  # of each unit
        number, whose = number[fresh], owner[fresh]
        last = np.r_[whose[1:] != whose[:-1], True]
        if start:
            band = coef[rows, start : end + 1]
            word, length, block = (_ac_refine_words if high else _ac_first_words)(band, low, fresh)
            interval = interval[block]
        elif high:
            word = coef[rows, 0] >> low & 1
            length, interval = np.ones(len(rows), np.int64), np.repeat(interval, orders[0].shape[1])
        else:
            unit_of = images[0].geometry.of_unit(chosen)
            word, length = _dc_words((coef[rows, 0] >> low).reshape(-1, len(unit_of)), unit_of, fresh)
            interval = np.repeat(interval, len(unit_of))
        data, ends = _packed(word, length, interval, last, number)
        ends = ends[last].tolist()
        data = data.tobytes()
        for im, head, a, z in zip(images, out, [0, *ends], ends):
            table = bytes([0x01 if high else 0x00])
            spec = bytes([len(chosen)]) + b"".join(bytes([im.idents[i]]) + table for i in chosen) + bytes([start, end, high << 4 | low])
            head += [_segment(0xDA, spec), data[a:z]]
    return [b"".join([*head, b"\xff\xd9"]) for head in out]


# ---- decoder


@dataclass
class _Scan:
    """A scan of one file: where its data lie, and what they mean."""

    file: int
    chosen: tuple[int, ...]
    start: int
    end: int
    high: int
    low: int
    tables: list[np.ndarray]
    data: bytes
    interval: int


_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


def _parse(file: int, data: bytes, most_blocks: int) -> tuple[Image, list[_Scan]]:
    """Frame and scans of a file, its coefficients still zero. ValueError, IndexError or KeyError for what isn't a progressive file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, quant, tables, interval, comment, scans = 2, None, {}, {}, 0, b"", []
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if n < 2 or at + 2 + n > len(data):
            raise ValueError("a segment of no length or beyond the end")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 64 * (1 + wide)
                if wide > 1 or len(body) <= size:
                    raise ValueError("a short quantisation table")
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("a short Huffman table")
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            if frame is not None or body[0] != 8 or body[5] not in (1, 3) or len(body) != 6 + 3 * body[5]:
                raise ValueError("a second frame, or one that isn't of 8 bits and one or three components")
            parts = [(body[i], (body[i + 1] >> 4, body[i + 1] & 15), body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            frame = geometry(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), tuple(p[1] for p in parts))
            idents, which = tuple(p[0] for p in parts), [p[2] for p in parts]
            if frame.blocks > most_blocks or len(set(idents)) < len(idents):
                raise ValueError("larger than allowed, or components of one name")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive file with Huffman codes")
        elif marker == 0xDA:
            found = _MARKER.search(data, at)
            stop = found.start() if found else len(data)
            if frame is None:
                raise ValueError("a scan before the frame")
            named = [(idents.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            start, end, high, low = body[1 + 2 * body[0]], body[2 + 2 * body[0]], body[3 + 2 * body[0]] >> 4, body[3 + 2 * body[0]] & 15
            chosen = tuple(i for i, _ in named)
            if not chosen or list(chosen) != sorted(set(chosen)) or start > end or end > 63 or (not start and end) or (start and len(chosen) > 1) or low > 13 or high and high != low + 1:
                raise ValueError("a scan that the format doesn't allow")
            used = [] if not start and high else [tables[16 | t & 15 if start else t >> 4] for _, t in named]
            scans.append(_Scan(file, chosen, start, end, high, low, used, data[at:stop], interval))
            at = stop
    if frame is None:
        raise ValueError("no frame")
    return Image(frame, np.zeros((0, 64), np.int32), [quant[q] for q in which], idents, interval, comment), scans


class _Lanes:
    """The restart intervals of several scans as lanes that are read in lockstep.

    word: the 64 bits from each byte on. pos, stop: next bit and end of a lane; first, count: its blocks among ``rows``;
    bad: files whose data are malformed.
    """

    def __init__(self, scans: list[_Scan], images: list[Image], base: list[int], bad: set[int]):
        raw = np.frombuffer(b"".join(s.data for s in scans) + b"\0", np.uint8)
        sizes = np.array([len(s.data) for s in scans])
        scan_at = np.cumsum(sizes) - sizes
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        follow = raw[ff + 1]
        stuffed, restart = ff[follow == 0], ff[(follow >= 0xD0) & (follow <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[-1] = False
        keep[stuffed + 1] = False
        keep[restart] = False
        keep[restart + 1] = False
        new_at = np.cumsum(keep) - keep
        begins = np.sort(np.r_[scan_at, restart + 2])
        scan_of = np.searchsorted(scan_at, begins, side="right") - 1
        # scans without data share a beginning with the next one and are told apart by their number
        clean = raw[keep]
        starts = new_at[np.minimum(begins, len(raw) - 1)]
        stops = np.r_[starts[1:], len(clean)]
        orders = [images[s.file].geometry.order(s.chosen) for s in scans]
        units, wide = np.array([len(o) for o in orders]), np.array([o.shape[1] for o in orders])
        step = np.array([s.interval for s in scans])
        step = np.where(step > 0, step, units)
        wanted = -(-units // step)
        fine = (np.bincount(scan_of, minlength=len(scans)) == wanted) & (sizes > 0)
        bad.update(s.file for s, x in zip(scans, fine.tolist()) if not x)
        self.scans, self.bad = [s for s, x in zip(scans, fine.tolist()) if x], bad
        if not self.scans:
            return
        mine = fine[scan_of]
        self.pos, self.stop = starts[mine] * 8, stops[mine] * 8
        orders, units, wide, step, wanted = [o for o, x in zip(orders, fine.tolist()) if x], units[fine], wide[fine], step[fine], wanted[fine]
        blocks = units * wide
        self.rows = np.concatenate([o.reshape(-1) for o in orders]) + np.repeat([base[s.file] for s in self.scans], blocks)
        self.scan = np.repeat(np.arange(len(wanted)), wanted)
        begin = (np.arange(len(self.scan)) - (np.cumsum(wanted) - wanted)[self.scan]) * step[self.scan]
        self.first = (np.cumsum(blocks) - blocks)[self.scan] + begin * wide[self.scan]
        self.count = (np.minimum(begin + step[self.scan], units[self.scan]) - begin) * wide[self.scan]
        good = self.scans
        self.file = np.array([s.file for s in good])[self.scan]
        self.start, self.end, self.low = (np.array([getattr(s, x) for s in good])[self.scan] for x in ("start", "end", "low"))
        padded = clean.tobytes() + bytes(16)
        self.word = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,)).astype(np.uint64)
        self.bits_end = len(clean) * 8 + 32
        tables: dict[int, int] = {}
        stack, ids = [], []
        for s in good:
            for t in s.tables:
                if id(t) not in tables:
                    tables[id(t)] = len(stack)
                    stack.append(t)
            ids.append([tables[id(t)] for t in s.tables])
        self.tables = np.concatenate(stack) if stack else np.zeros(0, np.int32)
        self.table = ids

    def window(self, pos: np.ndarray) -> np.ndarray:
        """The next bits of each lane, 57 at least, highest first."""
        pos = np.minimum(pos, self.bits_end)
        return self.word[pos >> 3] << (pos & 7).astype(np.uint64)

    def symbol(self, table: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table entries (symbol << 5 | length) of the next codes, and what follows them."""
        window = self.window(pos)
        entry = self.tables[table + (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        return entry, window << (entry & 31).astype(np.uint64)

    def bit(self, pos: np.ndarray) -> np.ndarray:
        return (self.window(pos) >> np.uint64(63)).astype(np.int64)

    def fail(self, lanes: np.ndarray) -> None:
        self.bad.update(np.unique(self.file[lanes]).tolist())


def _take(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits of windows, n < 64."""
    return (window >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values of n bits as the format codes them; 0 bits are 0."""
    return np.where((v >> np.maximum(n - 1, 0)) & 1, v, v - (1 << n) + 1)


def _dc_first(lanes: _Lanes, coef: np.ndarray, unit: tuple[int, ...]) -> None:
    tables = np.array(lanes.table)[lanes.scan] << 16
    before = np.zeros((len(lanes.pos), max(unit) + 1), np.int64)
    live = np.arange(len(lanes.pos))
    for k in range(int(lanes.count.max())):
        live = live[lanes.count[live] > k]
        c, pos = unit[k % len(unit)], lanes.pos[live]
        entry, rest = lanes.symbol(tables[live, c], pos)
        n = entry >> 5
        wrong = (entry == 0) | (n > 15)
        if wrong.any():
            lanes.fail(live[wrong])
            live, pos, entry, n, rest = (x[~wrong] for x in (live, pos, entry, n, rest))
        pos = pos + (entry & 31)
        before[live, c] += _extend(_take(rest, n), n)
        coef[lanes.rows[lanes.first[live] + k], 0] = np.clip(before[live, c] << lanes.low[live], -32768, 32767)
        lanes.pos[live] = pos + n


def _ac_first(lanes: _Lanes, coef: np.ndarray) -> None:
    table = np.array([t[0] for t in lanes.table])[lanes.scan] << 16
    every = (np.arange(len(lanes.pos)), lanes.pos.copy(), lanes.first.copy(), lanes.first + lanes.count, lanes.start.copy(), lanes.start, lanes.end, lanes.low, table)
    lane, pos, at, stop, k, start, end, low, table = every
    while len(lane):
        entry, rest = lanes.symbol(table, pos)
        symbol = entry >> 5
        skip, n = symbol >> 4, symbol & 15
        is_value = n > 0
        is_end = ~is_value & (skip < 15)
        take = np.where(is_value, n, np.where(is_end, skip, 0))
        extra = _take(rest, take)
        pos = pos + (entry & 31) + take
        k = k + skip
        wrong = (entry == 0) | (k > end) & ~is_end
        put = is_value & ~wrong
        v, size = extra[put], n[put]
        coef[lanes.rows[at[put]], k[put]] = np.where(v >> (size - 1), v, v - (1 << size) + 1) << low[put]
        k = k + 1
        done = is_end | (k > end)
        at = at + np.where(is_end, (1 << np.minimum(skip, 14)) + np.where(is_end, extra, 0), done)
        k = np.where(done, start, k)
        over = (at >= stop) | wrong
        if over.any():
            if wrong.any():
                lanes.fail(lane[wrong])
            if (beyond := at > stop).any():
                lanes.fail(lane[beyond])
            lanes.pos[lane[over]] = pos[over]
            left = ~over
            lane, pos, at, stop, k, start, end, low, table = (x[left] for x in (lane, pos, at, stop, k, start, end, low, table))


def _ac_refine(lanes: _Lanes, coef: np.ndarray) -> None:
    """Symbols in lockstep. A symbol leads to a zero; the known coefficients on the way have a bit each, which are noted and added at the end."""
    rows = lanes.rows
    first, last = int(lanes.start[0]), int(lanes.end[0])
    known = coef[rows, first : last + 1] != 0
    width = last - first + 1
    order = np.argsort(known, axis=1, kind="stable").astype(np.int64)  # zeros in order, then known ones in order
    zeros = width - known.sum(1)
    table = np.array([t[0] for t in lanes.table])[lanes.scan] << 16
    notes: list[tuple[np.ndarray, ...]] = []
    lane, pos, at, stop = np.arange(len(lanes.pos)), lanes.pos.copy(), lanes.first.copy(), lanes.first + lanes.count
    k, passed, run, unit = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.int64(1) << lanes.low
    while len(lane):
        in_run = run > 0
        entry, rest = lanes.symbol(table, pos)
        entry = np.where(in_run, 1 << 5, entry)  # stands for the end of one more band
        symbol = np.where(in_run, 0, entry >> 5)
        skip, n = symbol >> 4, symbol & 15
        is_end = (n == 0) & (skip < 15)
        take = np.where(n > 0, 1, np.where(is_end, skip, 0))
        extra = _take(rest, take)
        pos = pos + np.where(in_run, 0, (entry & 31) + take)
        run = np.where(in_run, run - 1, np.where(is_end, (1 << np.minimum(skip, 14)) + extra - 1, 0))
        target = passed + skip
        wrong = (entry == 0) | (n > 1) | ~is_end & (target >= zeros[at])
        to = np.where(is_end | wrong, width, order[at, np.minimum(target, width - 1)])
        # known coefficients between k and the target, or the rest of the band
        bits = np.where(is_end, (width - k) - (zeros[at] - passed), np.maximum(to - k - skip, 0))
        bits = np.where(wrong, 0, bits)
        some = bits > 0
        notes.append((at[some], (zeros[at] + k - passed)[some], bits[some], pos[some], unit[some]))
        pos = pos + bits
        put = (n == 1) & ~wrong
        coef[rows[at[put]], first + to[put]] = np.where(extra[put] == 1, unit[put], -unit[put])
        k, passed = to + 1, target + 1
        done = is_end | (k >= width)
        at = at + done
        k, passed = np.where(done, 0, k), np.where(done, 0, passed)
        over = (at >= stop) | wrong
        if over.any():
            if wrong.any():
                lanes.fail(lane[wrong])
            if (beyond := over & (run > 0)).any():
                lanes.fail(lane[beyond])
            lanes.pos[lane[over]] = pos[over]
            left = ~over
            lane, pos, at, stop, k, passed, run, unit, table = (x[left] for x in (lane, pos, at, stop, k, passed, run, unit, table))
    if notes:
        at, nth, bits, pos, unit = (np.concatenate(x) for x in zip(*notes))
        which = np.repeat(np.arange(len(at)), bits)
        step = np.arange(len(which)) - np.repeat(np.cumsum(bits) - bits, bits)
        bit = lanes.bit(pos[which] + step) == 1
        which, step = which[bit], step[bit]
        row, col = rows[at[which]], first + order[at[which], np.minimum(nth[which] + step, width - 1)]
        v, u = coef[row, col], unit[which]
        coef[row, col] = np.where(np.abs(v) & u, v, v + np.sign(v) * u)


def decode_many(files: list[bytes | None], most_blocks: int = MOST_BLOCKS) -> list[Image | None]:
    """All scans of progressive files, accumulated into coefficient arrays; None for null and for what isn't such a file.

    Scans that wait for no other, of one or of several files, are decoded together.
    """
    images: list[Image | None] = [None] * len(files)
    scans: list[list[_Scan]] = []
    bad: set[int] = set()
    base, total = [0] * len(files), 0
    for i, data in enumerate(files):
        try:
            if data is None:
                continue
            images[i], found = _parse(i, data, most_blocks)
        except (ValueError, IndexError, KeyError):
            images[i] = None
            continue
        base[i], total = total, total + images[i].geometry.blocks
        done: list[tuple[_Scan, int]] = []
        for s in found:  # after the last scan of the same coefficients
            turn = max((t + 1 for x, t in done if x.start <= s.end and s.start <= x.end and set(x.chosen) & set(s.chosen)), default=0)
            done.append((s, turn))
            if turn == len(scans):
                scans.append([])
            scans[turn].append(s)
    coef = np.zeros((total, 64), np.int32)
    for together in scans:
        kinds: dict = {}
        for s in together:
            if s.file not in bad:
                kind = (images[s.file].geometry.of_unit(s.chosen), bool(s.high)) if not s.start else (s.start if s.high else 1, s.end if s.high else 1, bool(s.high))
                kinds.setdefault((bool(s.start), kind), []).append(s)
        for (ac, kind), some in kinds.items():
            lanes = _Lanes(some, images, base, bad)
            if not lanes.scans:
                continue
            if ac:
                (_ac_refine if kind[2] else _ac_first)(lanes, coef)
            elif kind[1]:
                owner = np.repeat(np.arange(len(lanes.pos)), lanes.count)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(lanes.count) - lanes.count, lanes.count)
                coef[lanes.rows, 0] |= (lanes.bit(lanes.pos[owner] + step) << lanes.low[owner]).astype(np.int32)
                lanes.pos = lanes.pos + lanes.count
            else:
                _dc_first(lanes, coef, kind[0])
            if (short := lanes.pos > lanes.stop).any():
                lanes.fail(np.flatnonzero(short))
    for i, im in enumerate(images):
        if im is not None:
            im.coef = coef[base[i] : base[i] + im.geometry.blocks]
            if i in bad:
                images[i] = None
    return images


def decode(data: bytes, most_blocks: int = MOST_BLOCKS) -> Image:
    """As decode_many for one file; ValueError for what isn't a progressive file."""
    (found,) = decode_many([data], most_blocks)
    if found is None:
        raise ValueError("not a progressive JPEG file")
    return found


def samples_of(coef: np.ndarray) -> np.ndarray:
    """Blocks of dequantised coefficients to blocks of samples."""
    samples = coef.astype(np.float64) @ BASIS
    samples += (128 << SCALE) + (1 << (SCALE - 1))
    samples *= 1.0 / (1 << SCALE)
    return np.clip(np.floor(samples, out=samples), 0, 255, out=samples).astype(np.uint8)


def to_rgb(image: Image, samples: np.ndarray | None = None) -> np.ndarray:
    """height x width x 3 bytes: dequantised, inverse-transformed, chroma repeated to full resolution. One component gives grey.

    samples: of all blocks, if they are known already.
    """
    g = image.geometry
    hm, vm = max(h for h, _ in g.sampling), max(v for _, v in g.sampling)
    planes = []
    for i, (h, v) in enumerate(g.sampling):
        rows, cols = g.shapes[i]
        part = samples_of(image.part(i).reshape(-1, 64) * image.quant[i]) if samples is None else samples[g.starts[i] : g.starts[i + 1]]
        plane = part.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        if (h, v) != (hm, vm):
            plane = plane[np.arange(g.height) * v // vm][:, np.arange(g.width) * h // hm]
        planes.append(plane[: g.height, : g.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(np.int32) for p in planes)
    cb -= 128
    cr -= 128
    rgb = np.empty((g.height, g.width, 3), np.uint8)
    # ITU-R BT.601 as 16-bit fixed point
    for c, more in enumerate(((91881 * cr + 32768) >> 16, -((22554 * cb + 46802 * cr + 32768) >> 16), (116130 * cb + 32768) >> 16)):
        rgb[:, :, c] = np.clip(y + more, 0, 255)
    return rgb


# ---- payloads and media columns


def _values() -> tuple[np.ndarray, np.ndarray]:
    """Byte to coefficient, and coefficient + 128 to byte: 0, 1, -1, 2, -2, ... by falling frequency."""
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    to, back = np.zeros(256, np.int32), np.zeros(257, np.uint8)
    for rank, b in enumerate(order):
        v = (rank + 1) // 2 * (1 if rank % 2 else -1)
        to[b], back[v + 128] = v, b
    return to, back


TO_COEFFICIENT, TO_BYTE = _values()
_ONES = np.ones(64, np.uint8)


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Bytes as the coefficients of 4:2:0 images; payload_of(decode()) gives them back exactly."""
    images = []
    for payload in payloads:
        n = -(-len(payload) // MCU_BYTES)
        rows = -(-n // MOST_COLUMNS)
        cols = -(-n // rows)
        cells = TO_COEFFICIENT[np.frombuffer(payload.ljust(rows * cols * MCU_BYTES, b" "), np.uint8)].reshape(rows, cols, 6, 64)
        luma = cells[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4)
        coef = np.concatenate([x.reshape(-1, 64) for x in (luma, cells[:, :, 4], cells[:, :, 5])])
        images.append(Image(geometry(16 * cols, 16 * rows, SAMPLING), coef, [_ONES], interval=INTERVAL, comment=str(len(payload)).encode()))
    return encode_many(images) if images else []


def store(payload: bytes) -> bytes:
    return store_many([payload])[0]


def payload_of(image: Image) -> bytes:
    g = image.geometry
    cells = np.empty((g.rows, g.cols, 6, 64), np.int32)
    cells[:, :, :4] = image.part(0).reshape(g.rows, 2, g.cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(g.rows, g.cols, 4, 64)
    cells[:, :, 4], cells[:, :, 5] = image.part(1), image.part(2)
    return TO_BYTE[cells + 128].tobytes()[: int(image.comment)]


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(texts: list[bytes | None]) -> list[tuple]:
    bodies = [t or b"" for t in texts]
    files = store_many([t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT)) for t in bodies])
    images = decode_many(files, most_blocks=1 << 40)
    every, found, at = samples_of(np.concatenate([im.coef for im in images])), [], 0  # quantisation steps are 1
    for text, media, image in zip(bodies, files, images):
        back, rgb = payload_of(image), to_rgb(image, every[at : at + len(image.coef)])
        at += len(image.coef)
        feature = f"{rgb.shape[0]}x{rgb.shape[1]}x3:{zlib.crc32(rgb):08x}:{int(rgb.sum(dtype=np.int64))}"
        found.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    return found


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``most`` bytes together, or of one larger row."""
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def text_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's text stored as a progressive JPEG, read back and turned into an RGB tensor; what is returned is computed from the stored bytes.

    Null and empty texts are one unit of spaces. Equal texts give equal values whatever is encoded with them; repeated
    rows come back each; an empty table gives an empty one. A task holds TOGETHER bytes of texts, or one longer text,
    with some 200 bytes of work space for each byte.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for at, end in _groups([max(UNIT, len(t or b"")) for t in texts], TOGETHER):
                found = _features(texts[at:end])
                columns = [pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), *columns], ["doc_id", *(f.split()[0] for f in FEATURES.split(", "))])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return given.mapInArrow(rows, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {FEATURES}")


def decode_media(df: DataFrame, media: str, prefix: str = "", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``df`` plus height, width and rgb (row-major bytes of the full-resolution tensor) of a column of JPEG files.

    Null for a null, for what isn't a progressive JPEG, and for images of more than ``most_blocks`` blocks; columns named
    like the new ones (with ``prefix``) are replaced.
    """
    names = [f"{prefix}{x}" for x in ("height", "width", "rgb")]
    df = df.drop(*names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(b.schema.get_field_index(media)).to_pylist()
            for at, end in _groups([len(x or b"") for x in files], TOGETHER):
                found = []
                for i in range(at, end, 16):  # few at a time: a small file can be a large image
                    for image in decode_many(files[i : min(i + 16, end)], most_blocks):
                        rgb = to_rgb(image) if image is not None else None
                        found.append((None, None, None) if rgb is None else (rgb.shape[0], rgb.shape[1], rgb.tobytes()))
                new = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                some = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*some.columns, *new], [*some.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{names[0]}` int", f"`{names[1]}` int", f"`{names[2]}` binary"])
    return df.mapInArrow(rows, schema)
